"""UTF-16 and WTF-8 forms of strings that may hold lone surrogates (plain Python, for Arrow functions)."""

from __future__ import annotations


def code_points(units: list[int], compat: bool = False) -> list[int]:
    """Code points of UTF-16 units: pairs are joined, lone halves stay. ``compat`` keeps six bits of either half only."""
    kept = 0x3F if compat else 0x3FF
    out: list[int] = []
    for u in units:
        if 0xDC00 <= u <= 0xDFFF and out and 0xD800 <= out[-1] <= 0xDBFF:
            out[-1] = 0x10000 + ((out[-1] & kept) << 10) + (u & kept)
        else:
            out.append(u)
    return out


def wtf8(points: list[int], compat: bool = False) -> bytes:
    """UTF-8, with surrogates as points of their own. ``compat`` writes points below 256 as one byte."""
    if compat:
        return b"".join(bytes([p]) if p < 0x100 else chr(p).encode("utf-8", "surrogatepass") for p in points)
    return "".join(map(chr, points)).encode("utf-8", "surrogatepass")


def utf16_units(text: str) -> list[int]:
    """The UTF-16 units of a text, lone surrogates included."""
    data = text.encode("utf-16-be", "surrogatepass")
    return [data[i] << 8 | data[i + 1] for i in range(0, len(data), 2)]


def text_bytes(text: str, compat: bool = False) -> bytes:
    """A text as WTF-8: UTF-8, with three bytes for a surrogate that has no partner."""
    return wtf8(code_points(utf16_units(text), compat), compat)
