"""Small inputs with the awkward cases, and plain reimplementations to compare with."""

import re
import zlib

WORDS = re.compile(rb"[^\x20\x09-\x0D]+")


def lower_az(text: str | None) -> bytes:
    return re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())


def words(text: str | None, lower: bool = True) -> list[bytes]:
    return WORDS.findall(lower_az(text) if lower else (text or "").encode())


def crc(value) -> int:
    return zlib.crc32(b"" if value is None else str(value).encode())


def documents(spark, rows, extra: bool = True):
    """rows: (doc_id, text). Adds nulls in other columns, and columns whose names operators use themselves."""
    if not extra:
        return spark.createDataFrame(rows, "doc_id long, text string")
    return spark.createDataFrame(
        [(i, t, None, None, None, "x", 1.5, 7) for i, t in rows],
        "doc_id long, text string, lang string, source string, n_chars long, size string, score double, row long",
    )


def small_corpus(spark, limit_sf: str = "/root/testdata/sf0.001"):
    got = spark.read.parquet(f"{limit_sf}/documents.parquet").select("doc_id", "text").collect()
    return [(r.doc_id, r.text) for r in got]


def shingles(text: str | None) -> frozenset:
    w = words(text)
    return frozenset(zip(*(w[i:] for i in range(5)))) if len(w) >= 5 else frozenset([tuple(w)])


def similarity(a: str | None, b: str | None) -> float:
    """Jaccard similarity of two texts' sets of five-word shingles."""
    a, b = shingles(a), shingles(b)
    return len(a & b) / max(1, len(a | b))
