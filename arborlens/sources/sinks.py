"""Where bytes and texts go: memory, files, the console. A text sink encodes UTF-16 halves that stand alone as WTF-8."""

from __future__ import annotations

import sys
from collections.abc import Callable

from arborlens.functions.text_codes import text_bytes


class ByteSink:
    """Gathers bytes and hands them on in blocks of ``block`` bytes, the rest when flushed."""

    def __init__(self, write: Callable[[bytes], object], block: int = 1 << 16):
        self._write, self._block, self._held, self.written = write, block, bytearray(), 0

    def write(self, *data: bytes) -> None:
        for d in data:
            self._held += d
            self.written += len(d)
        while len(self._held) >= self._block:
            self._write(bytes(self._held[: self._block]))
            del self._held[: self._block]

    def flush(self) -> None:
        if self._held:
            self._write(bytes(self._held))
            self._held.clear()


class TextSink:
    """Writes texts to a byte sink."""

    def __init__(self, sink: ByteSink):
        self._sink = sink

    def write(self, *texts: str) -> None:
        for t in texts:
            self._sink.write(text_bytes(t))

    def flush(self) -> None:
        self._sink.flush()


class MemoryBytes(ByteSink):
    """Keeps what is written."""

    def __init__(self):
        self._kept = bytearray()
        super().__init__(self._kept.extend)

    def value(self) -> bytes:
        self.flush()
        return bytes(self._kept)


class MemoryText(TextSink):
    def __init__(self):
        self._bytes = MemoryBytes()
        super().__init__(self._bytes)

    def value(self) -> str:
        return self._bytes.value().decode("utf-8", "surrogatepass")


class ConsoleText:
    """Writes whole lines to the console, each behind a prefix; an unfinished one waits for its end or a flush."""

    def __init__(self, prefix: str = "", out=None):
        self._prefix, self._out, self._open = prefix, out or sys.stdout, ""

    def write(self, *texts: str) -> None:
        *lines, self._open = (self._open + "".join(texts)).split("\n")
        for line in lines:
            self._out.write(f"{self._prefix}{line}\n")

    def flush(self) -> None:
        if self._open:
            self.write("\n")
        self._out.flush()


def log(message: str) -> None:
    """A line on standard output, tried again while a pipe is full."""
    while True:
        try:
            sys.stdout.write(f"{message}\n")
            sys.stdout.flush()
            return
        except BlockingIOError:
            continue
