"""What encoding and line ending a file has, from its beginning."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import SparkSession

from .files import Files

# How much is looked at.
SAMPLE_BYTES = 65_536
PAIRS = 2_048
ZERO_SHARE = 0.7
ENDING_CHARACTERS = 32_768


#: The code page of what is neither UTF-8 nor UTF-16.
ANSI = "cp1252"


@dataclass(frozen=True)
class TextEncoding:
    """``name`` is Python's, ``label`` is for people."""

    name: str
    label: str
    bom: bool = False
    preamble: int = 0


UTF8 = TextEncoding("utf-8", "UTF-8")


def detect(sample: bytes, whole: bool = False, fallback: str = ANSI) -> TextEncoding:
    """The encoding of a file that begins with ``sample``; ``whole``: there is no more of it."""
    if sample[:4] == b"\xff\xfe\0\0" and len(sample) >= 4:
        raise ValueError("UTF-32 is not read")
    if sample[:3] == b"\xef\xbb\xbf":
        return TextEncoding("utf-8", "UTF-8 BOM", True, 3)
    if sample[:2] == b"\xff\xfe":
        return TextEncoding("utf-16-le", "UTF-16 LE", True, 2)
    if sample[:2] == b"\xfe\xff":
        return TextEncoding("utf-16-be", "UTF-16 BE", True, 2)
    if len(sample) >= 4:
        pairs = min(PAIRS, len(sample) // 2)
        low, high = sample[0 : 2 * pairs : 2], sample[1 : 2 * pairs : 2]
        if high.count(0) > ZERO_SHARE * pairs:
            return TextEncoding("utf-16-le", "UTF-16 LE")
        if low.count(0) > ZERO_SHARE * pairs:
            return TextEncoding("utf-16-be", "UTF-16 BE")
    try:
        sample.decode("utf-8")
        return TextEncoding("utf-8", "UTF-8")
    except UnicodeDecodeError as e:
        # A character that the end of the sample cuts is no sign of another encoding.
        if not whole and e.reason == "unexpected end of data" and len(sample) - e.start <= 3:
            return TextEncoding("utf-8", "UTF-8")
    return TextEncoding(fallback, f"ANSI ({fallback})")


def detect_file(spark: SparkSession, path: str, fallback: str = ANSI) -> TextEncoding:
    sample = Files(spark).head(path, SAMPLE_BYTES)
    return detect(sample, whole=len(sample) < SAMPLE_BYTES, fallback=fallback)


def line_ending(text: str) -> str:
    """The most frequent of CRLF, LF and CR, in this order if even; 'unknown' without any."""
    text = text[:ENDING_CHARACTERS]
    both = text.count("\r\n")
    counts = {"CRLF": both, "LF": text.count("\n") - both, "CR": text.count("\r") - both}
    best = max(counts, key=counts.get)
    return best if counts[best] else "unknown"
