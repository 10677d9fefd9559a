"""Wire encoding of replies as column expressions, and the incremental parser of requests."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

CRLF = "\r\n"


def _bytes(text: Column) -> Column:
    return F.octet_length(text).cast("string")


def simple(text: Column) -> Column:
    return F.concat(F.lit("+"), text, F.lit(CRLF))


def error(message: Column) -> Column:
    """Line breaks in the message become spaces: an echoed name cannot add lines."""
    return F.concat(F.lit("-ERR "), F.translate(message, CRLF, "  "), F.lit(CRLF))


def integer(value: Column) -> Column:
    return F.concat(F.lit(":"), value.cast("string"), F.lit(CRLF))


def bulk(text: Column) -> Column:
    return F.concat(F.lit("$"), _bytes(text), F.lit(CRLF), text, F.lit(CRLF))


def null() -> Column:
    return F.lit("$-1" + CRLF)


def array(items: Column) -> Column:
    return F.concat(F.lit("*"), F.size(items).cast("string"), F.lit(CRLF), F.array_join(F.transform(items, bulk), ""))


class ProtocolError(ValueError):
    pass


@dataclass
class RequestParser:
    """Feeds on pieces of a connection's bytes and gives whole commands; what is left over waits for more.

    A request is an array of bulk strings. Blank lines between requests are skipped, ``*0`` is an empty command, a null
    bulk is an empty string. Anything else raises and ends the connection.
    """

    rest: bytes = b""
    most_bulk: int = 512 << 20
    _ready: list[list[bytes]] = field(default_factory=list)

    def feed(self, data: bytes) -> list[list[bytes]]:
        self.rest += data
        out = []
        while (got := self._one()) is not None:
            out.append(got)
        return out

    def _number(self, at: int, mark: bytes) -> tuple[int, int] | None:
        end = self.rest.find(b"\r\n", at)
        if self.rest[at : at + 1] not in (mark, b""):
            raise ProtocolError(f"expected {mark!r}")
        if end < 0:
            return None
        digits = self.rest[at + 1 : end]
        if not digits.lstrip(b"-").isdigit() or digits.count(b"-") > 1 or digits[1:].count(b"-"):
            raise ProtocolError(f"not a length: {digits!r}")
        return int(digits), end + 2

    def _one(self) -> list[bytes] | None:
        while self.rest.startswith(b"\r\n"):
            self.rest = self.rest[2:]
        if not self.rest or self.rest == b"\r":
            return None
        head = self._number(0, b"*")
        if head is None:
            return None
        n, at = head
        if n < 0:
            raise ProtocolError("negative array length")
        words = []
        for _ in range(n):
            size = self._number(at, b"$")
            if size is None:
                return None
            length, at = size
            if length < -1 or length > self.most_bulk:
                raise ProtocolError("bulk length out of range")
            if length == -1:
                words.append(b"")
                continue
            if len(self.rest) < at + length + 2:
                return None
            if self.rest[at + length : at + length + 2] != b"\r\n":
                raise ProtocolError("bulk string without its line end")
            words.append(self.rest[at : at + length])
            at += length + 2
        self.rest = self.rest[at:]
        return words

    def reset(self) -> None:
        """Forget what is left over."""
        self.rest = b""


@udtf(returnType="conn_id long, req_seq long, argv array<string>, error string")
class ParseRequests:
    """Table function over rows (conn_id, piece, data) of one connection, in order. Words that are not UTF-8 keep U+FFFD in place."""

    def __init__(self):
        self.parser, self.n, self.closed = RequestParser(), 0, False

    def eval(self, row):
        if self.closed or row["data"] is None:
            return
        self.parser.rest += bytes(row["data"])
        while True:
            try:
                words = self.parser._one()
            except ProtocolError:
                self.closed = True
                self.parser.reset()
                yield row["conn_id"], self.n, None, "-ERR protocol error\r\n"
                return
            if words is None:
                return
            yield row["conn_id"], self.n, [w.decode("utf-8", "replace") for w in words], None
            self.n += 1
