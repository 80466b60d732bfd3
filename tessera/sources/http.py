"""Landing of remote documents and files, with limits on attempts, time and size. Reads happen on the driver; Spark reads what landed."""

from __future__ import annotations

import datetime
import hashlib
import json
import os
import time
import urllib.error
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# What is tried again.
RETRIED = (408, 425, 429)
BLOCK = 1 << 20


class SourceError(RuntimeError):
    """A source that could not be read, with a code that may be logged."""

    def __init__(self, code: str, source: str):
        super().__init__(f"{code} for {source}")
        self.code, self.source = code, source


def attempts(statuses: Column, most: int = 2) -> Column:
    """struct(used, status, ok) of a source that answers with these statuses in turn; 0 stands for a network failure or a timeout.

    Network failures, timeouts, 408, 425, 429 and 5xx are tried again, up to `most` attempts; another answer is final.
    """
    again = lambda s: s.isin(0, *RETRIED) | s.between(500, 599)
    tried = F.slice(statuses, 1, most)
    final = F.array_position(F.transform(tried, lambda s: ~again(s)), F.lit(True))
    used = F.when(final > 0, final).otherwise(F.size(tried)).cast("int")
    status = F.when(used > 0, F.get(tried, used - 1))
    return F.struct(used.alias("used"), status.alias("status"), F.coalesce(status.between(200, 299), F.lit(False)).alias("ok"))


@dataclass(frozen=True)
class Landed:
    source: str
    body: str
    requested_url: str
    response_url: str
    retrieved_at: str
    attempts: int


Answer = tuple[int, str, str, bytes]


def get(url: str, timeout: float, agent: str = "tessera") -> Answer:
    """Status, content type, final URL and body of a GET; the timeout holds for reading the body too."""
    request = urllib.request.Request(url, headers={"Accept": "application/json", "User-Agent": agent})
    ends = time.monotonic() + timeout
    try:
        with urllib.request.urlopen(request, timeout=timeout) as answer:
            parts = []
            while block := answer.read(BLOCK):
                parts.append(block)
                if time.monotonic() > ends:
                    raise TimeoutError
            return answer.status, answer.headers.get("Content-Type", ""), answer.url, b"".join(parts)
    except urllib.error.HTTPError as error:
        return error.code, "", url, b""


def document(source: str, url: str, fetch: Callable[[str, float], Answer] = get, now: Callable[[], datetime.datetime] | None = None, sleep: Callable[[float], None] = time.sleep, timeout: float = 5.0, most: int = 2, delay: float = 0.2) -> Landed:
    """A JSON document with its provenance. Codes: SOURCE_TIMEOUT, SOURCE_NETWORK_ERROR, SOURCE_HTTP_STATUS, SOURCE_CONTENT_TYPE, SOURCE_INVALID_JSON."""
    clock = now or (lambda: datetime.datetime.now(datetime.timezone.utc))
    for attempt in range(1, most + 1):
        code = None
        try:
            status, kind, final, body = fetch(url, timeout)
            if status in RETRIED or 500 <= status <= 599:
                code = "SOURCE_HTTP_STATUS"
            elif not 200 <= status <= 299:
                raise SourceError("SOURCE_HTTP_STATUS", source)
        except TimeoutError:
            code = "SOURCE_TIMEOUT"
        except OSError:
            code = "SOURCE_NETWORK_ERROR"
        if code is None:
            break
        if attempt == most:
            raise SourceError(code, source)
        sleep(delay)
    if kind.split(";")[0].strip().lower() not in ("application/json", "text/json"):
        raise SourceError("SOURCE_CONTENT_TYPE", source)
    try:
        text = body.decode("utf-8")
        json.loads(text)
    except ValueError:
        raise SourceError("SOURCE_INVALID_JSON", source) from None
    return Landed(source, text, url, final, clock().strftime("%Y-%m-%dT%H:%M:%S.") + f"{clock().microsecond // 1000:03d}Z", attempt)


def download(url: str, target: str, most_bytes: int, most_seconds: float = 120.0, agent: str = "tessera") -> dict[str, object]:
    """Stream a file to target in blocks: its size, SHA-256 and content type. A longer, slower or empty one is an error and leaves nothing."""
    request = urllib.request.Request(url, headers={"User-Agent": agent})
    ends, size, digest = time.monotonic() + most_seconds, 0, hashlib.sha256()
    temporary = f"{target}.part"
    try:
        with urllib.request.urlopen(request, timeout=most_seconds) as answer, open(temporary, "wb") as out:
            if int(answer.headers.get("Content-Length") or 0) > most_bytes:
                raise SourceError("SOURCE_TOO_LARGE", url)
            while block := answer.read(BLOCK):
                size += len(block)
                if size > most_bytes:
                    raise SourceError("SOURCE_TOO_LARGE", url)
                if time.monotonic() > ends:
                    raise SourceError("SOURCE_TIMEOUT", url)
                digest.update(block)
                out.write(block)
            kind = answer.headers.get("Content-Type", "")
        if not size:
            raise SourceError("SOURCE_EMPTY", url)
        os.replace(temporary, target)
    finally:
        if os.path.exists(temporary):
            os.unlink(temporary)
    return {"url": url, "size_bytes": size, "sha256": digest.hexdigest(), "content_type": kind}
