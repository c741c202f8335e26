"""The digest as an e-mail of two alternatives, and its sending over a pluggable transport."""

from __future__ import annotations

import logging
import re
import smtplib
import uuid
from base64 import b64encode, encodebytes
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from email.message import EmailMessage
from email.policy import SMTP
from itertools import chain

SUBJECT = "[Literature] %d new paper(s)"
#: Bytes of a page up to which the message is made whole, and bytes to a base64 line.
WHOLE, LINE = 1 << 20, 57
log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Mailbox:
    """Where the digest goes, and the account that sends it."""

    recipients: list[str] = field(default_factory=list)
    user: str = ""
    password: str = ""
    sender: str = ""
    host: str = "localhost"
    port: int = 587


def message(new: int, plain: str, html: str, box: Mailbox) -> EmailMessage:
    out = EmailMessage()
    out["Subject"], out["From"], out["To"] = SUBJECT % new, box.sender or box.user, ", ".join(box.recipients)
    out.set_content(plain or "New papers available.")
    out.add_alternative(html, subtype="html")
    return out


def _encoded(html: Iterable[bytes]) -> Iterator[bytes]:
    """Base64 lines of a page in pieces."""
    left = b""
    for piece in html:
        left += piece
        cut = len(left) // LINE * LINE
        yield encodebytes(left[:cut]).replace(b"\n", b"\r\n")
        left = left[cut:]
    yield encodebytes(left).replace(b"\n", b"\r\n")


def streamed(new: int, plain: str, html: Iterable[bytes], box: Mailbox) -> Iterator[bytes]:
    """The bytes of the message, for a page that doesn't fit the memory: its own stand where those of a mark would."""
    mark = uuid.uuid4().hex[:30]  # so that its base64 ends with a whole group
    out = message(new, plain, "", box)
    out.get_payload()[1].set_content(mark, subtype="html", cte="base64")
    before, after = out.as_bytes(policy=SMTP).split(b64encode(mark.encode()))
    yield re.sub(rb"(?m)^\.", b"..", before)
    yield from _encoded(html)
    yield after[after.index(b"\r\n") + 2 :]


def _stream(server: smtplib.SMTP, data: Iterable[bytes], box: Mailbox) -> None:
    """What send_message does, but for data in pieces."""
    server.ehlo_or_helo_if_needed()
    code, told = server.mail(box.sender or box.user)
    if code != 250:
        raise smtplib.SMTPSenderRefused(code, told, box.sender or box.user)
    refused = {to: said for to in box.recipients if (said := server.rcpt(to))[0] not in (250, 251)}
    if len(refused) == len(box.recipients):
        raise smtplib.SMTPRecipientsRefused(refused)
    code, told = server.docmd("DATA")
    if code != 354:
        raise smtplib.SMTPDataError(code, told)
    for piece in data:
        server.send(piece)
    server.send(b"\r\n.\r\n")
    code, told = server.getreply()
    if code != 250:
        raise smtplib.SMTPDataError(code, told)


def send(new: int, plain: str, html: Iterable[bytes], box: Mailbox, transport: Callable = smtplib.SMTP) -> bool:
    """Whether the digest was sent: not without recipients, an account or new papers, nor after a failure. A large page is sent piece by piece."""
    missing = [what for what, there in (("recipients", box.recipients), ("account", box.user and box.password), ("new papers", new)) if not there]
    if missing:
        log.warning("no %s: no e-mail", ", ".join(missing))
        return False
    try:
        with transport(box.host, box.port) as server:
            server.starttls()
            server.login(box.user, box.password)
            pieces, first, size = iter(html), [], 0
            while size <= WHOLE and (piece := next(pieces, None)) is not None:
                first, size = [*first, piece], size + len(piece)
            if size <= WHOLE:
                server.send_message(message(new, plain, b"".join(first).decode(), box))
            else:
                _stream(server, streamed(new, plain, chain(first, pieces), box), box)
    except (OSError, smtplib.SMTPException):
        log.exception("the digest was not sent")
        return False
    return True
