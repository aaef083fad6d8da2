"""Source documents over HTTP: a row for every URL with the body, its hash, and how the request went.

Failures are values in the row, so that one source never ends the run of the others. Certificates are always
verified; a chain that a server leaves incomplete is an error of its row.
"""

from __future__ import annotations

import hashlib
import urllib.error
import urllib.request
from collections.abc import Iterator
from dataclasses import astuple, dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes read at a time, seconds a request may take, first bytes searched for a login page.
BLOCK, PATIENCE, FIRST = 1 << 16, 120.0, 1024


@dataclass
class Fetched:
    url: str
    resolved_url: str | None = None
    redirected: bool = False
    http_status: int | None = None
    error: str | None = None
    content: bytes | None = None
    content_hash: str | None = None


def complaint(content: bytes, expect: str) -> str | None:
    """What is wrong with a body that should be a document; declared types other than pdf are taken as they come."""
    if expect != "pdf" or content.startswith(b"%PDF"):
        return None
    head = content[:FIRST].decode("utf-8", "replace").lower()
    return "a login page in place of the document" if "login" in head or "sign in" in head else "not a document"


def fetch(url: str, patience: float = PATIENCE, most: int | None = None) -> Fetched:
    """One source, redirects followed, hashed as it arrives; bodies beyond ``most`` bytes are an error, never cut."""
    out = Fetched(url)
    if not url.lower().startswith(("http://", "https://")):
        out.error = "not a web address"
        return out
    try:
        with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": "lexgrid"}), timeout=patience) as reply:
            out.http_status, out.resolved_url = reply.status, reply.geturl()
            out.redirected = out.resolved_url != url
            digest, body = hashlib.sha256(), bytearray()
            while block := reply.read(BLOCK):
                digest.update(block)
                body += block
                if most is not None and len(body) > most:
                    out.error = f"more than {most} bytes"
                    return out
            out.content, out.content_hash = bytes(body), digest.hexdigest()
    except urllib.error.HTTPError as e:
        out.http_status, out.resolved_url = e.code, e.url
        out.redirected = out.resolved_url != url
    except (OSError, ValueError) as e:
        out.error = f"{type(e).__name__}: {e}"[:200]
    return out


_NAMES = {"url": pa.string(), "resolved_url": pa.string(), "redirected": pa.bool_(), "http_status": pa.int32(), "error": pa.string(), "content": pa.binary(), "content_hash": pa.string()}
_DDL = "url string, resolved_url string, redirected boolean, http_status int, error string, content binary, content_hash string"


def fetched(sources: DataFrame, url: str, tasks: int = 8, most: int | None = None) -> DataFrame:
    """A row for every distinct URL that is not null; each is asked once, by ``tasks`` tasks at a time.

    Write the result before it is used twice, as any action asks again.
    """

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for u in batch.column(0).to_pylist():
                row = astuple(fetch(u, most=most))
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, _NAMES.values(), strict=True)], list(_NAMES))

    wanted = sources.select(F.col(url).alias("url")).where("url IS NOT NULL").distinct().repartition(tasks, "url")
    return wanted.mapInArrow(ask, _DDL)
