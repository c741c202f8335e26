"""The requests of the six services; `searches` has executors make them."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from datetime import date
from urllib.parse import quote_plus, urlencode
from urllib.request import Request, urlopen

LIMIT = 50
# Addresses, parameters and pauses (seconds) of the services; {query}, {limit}, {start} and {end} are filled in.
PUBMED_SEARCH = ("https://eutils.ncbi.nlm.nih.gov/entrez/eutils/esearch.fcgi", {"db": "pubmed", "term": "{query}", "retmax": "{limit}", "sort": "date", "retmode": "json"})
PUBMED_RECORDS = ("https://eutils.ncbi.nlm.nih.gov/entrez/eutils/efetch.fcgi", {"db": "pubmed", "id": "{ids}", "retmode": "xml"})
SERVICES = {
    "pubmed": PUBMED_SEARCH,
    "biorxiv": ("https://api.biorxiv.org/details/biorxiv/{start}/{end}/0/{limit}", {}),
    "arxiv": ("https://export.arxiv.org/api/query", {"search_query": "all:{quoted}", "start": "0", "max_results": "{limit}", "sortBy": "submittedDate", "sortOrder": "descending"}),
    "semantic_scholar": ("https://api.semanticscholar.org/graph/v1/paper/search", {"query": "{query}", "limit": "{limit}", "fields": "title,authors,abstract,year,externalIds,venue,publicationDate,url"}),
    "europepmc": ("https://www.ebi.ac.uk/europepmc/webservices/rest/search", {"query": "{query}", "format": "json", "pageSize": "{limit}", "sort": "date", "resultType": "core"}),
    "crossref": ("https://api.crossref.org/works", {"query": "{query}", "rows": "{limit}", "sort": "published", "order": "desc", "select": "DOI,title,author,abstract,container-title,published,URL"}),
}
MOST = {"semantic_scholar": 100, "europepmc": 100, "crossref": 50}
PAUSE, PUBMED_PAUSE, TIMEOUT = 0.5, 0.4, 30


def address(service: tuple[str, dict[str, str]], **filled: str) -> str:
    base, parameters = service
    asked = urlencode({k: v.format(**filled) for k, v in parameters.items()})
    return base.format(**filled) + (f"?{asked}" if asked else "")


def year_before(day: date) -> date:
    return day.replace(year=day.year - 1, day=min(day.day, 28) if day.month == 2 else day.day)


def mirrored(url: str, source: str, mirror: str | None) -> str:
    """A service's address, or the same request to a mirror."""
    return f"{mirror.rstrip('/')}/{source}/{url.split('/', 3)[3]}" if mirror else url


def search_address(source: str, query: str, start: date, end: date, limit: int = LIMIT) -> str:
    """The request of a search; bioRxiv's is for all papers between the dates, to be filtered afterwards."""
    return address(SERVICES[source], query=query, quoted=quote_plus(query), limit=str(min(limit, MOST.get(source, limit))), start=start.isoformat(), end=end.isoformat())


def get(url: str) -> bytes:
    with urlopen(Request(url, headers={"User-Agent": "citeloom/1.0", "Accept": "application/json, application/xml"}), timeout=TIMEOUT) as answer:
        return answer.read()


def answer(source: str, query: str, start: date, end: date, limit: int = LIMIT, ask: Callable[[str], bytes] = get, mirror: str | None = None, pause: float = PUBMED_PAUSE) -> bytes | None:
    """What a service answers a search; None if it finds nothing. PubMed's takes two requests."""
    found = ask(mirrored(search_address(source, query, start, end, limit), source, mirror))
    if source != "pubmed":
        return found
    ids = json.loads(found).get("esearchresult", {}).get("idlist", [])
    if not ids:
        return None
    time.sleep(min(pause, PUBMED_PAUSE))
    return ask(mirrored(address(PUBMED_RECORDS, ids=",".join(ids)), source, mirror))
