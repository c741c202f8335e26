"""DataFrame operators over papers."""
