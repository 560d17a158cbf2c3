"""Language identification by prediction by partial matching (PPM) over bytes."""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast, chunks, crc_of_id, load

#: Every text is read as if this many line feeds stood before it.
PAD = 10


@dataclass(frozen=True)
class PpmModel:
    """For each language and order k: sorted (k+1)-byte grams with counts, and their k-byte contexts.

    grams[lang][k], counts[lang][k]: the grams and how often each occurred.
    contexts[lang][k], totals[lang][k], kinds[lang][k]: the contexts, how often each was
    followed by a byte, and by how many different ones.
    """

    languages: list[str]
    order: int
    grams: list[list[np.ndarray]]
    counts: list[list[np.ndarray]]
    contexts: list[list[np.ndarray]]
    totals: list[list[np.ndarray]]
    kinds: list[list[np.ndarray]]


def windows(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The last `width` bytes up to each byte of each text, as integers, and how many bytes each text has."""
    size = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    data = np.full(int((size + width - 1).sum()), PAD, np.uint8)
    own = np.arange(int(size.sum())) + np.repeat((np.arange(len(size)) + 1) * (width - 1), size)
    joined = b"".join(texts.cast(pa.large_binary()).to_pylist())
    data[own] = np.frombuffer(joined, np.uint8)
    value = np.zeros(len(data) - width + 1 if len(data) >= width else 0, np.uint64)
    for k in range(width):
        value = (value << np.uint64(8)) | data[k : k + len(value)]
    return value[own - width + 1], size


def find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each key stands in a sorted table, and whether it does."""
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


def code_lengths(model: PpmModel, keys: np.ndarray) -> np.ndarray:
    """Bits that each language's model takes for the last byte of each window after the bytes before it.

    From the longest context down: a byte seen there n times costs
    -log2(n / (total + kinds)), else an escape costs -log2(kinds / (total + kinds)); a
    context never seen costs nothing. Below order 0 all 256 bytes are alike.
    """
    bits = np.zeros((len(model.languages), len(keys)))
    for lang in range(len(model.languages)):
        open_ = np.ones(len(keys), bool)
        for k in range(model.order, -1, -1):
            mask = np.uint64((1 << 8 * (k + 1)) - 1)
            gram = keys & mask
            at, seen = find(model.contexts[lang][k], gram >> np.uint64(8))
            seen &= open_
            if not seen.any():
                continue
            total = model.totals[lang][k][at] + model.kinds[lang][k][at]
            g, hit = find(model.grams[lang][k], gram)
            hit &= seen
            bits[lang][hit] += np.log2(total[hit] / model.counts[lang][k][g[hit]])
            escaped = seen & ~hit
            bits[lang][escaped] += np.log2(total[escaped] / model.kinds[lang][k][at[escaped]])
            open_ &= ~hit
        bits[lang][open_] += 8
    return bits


def train(docs: DataFrame, order: int = 3, docs_per_language: int = 1000, seed: int = 7) -> PpmModel:
    """Counts the byte grams of a bounded sample of labelled documents.

    `docs` has doc_id, text, lang; rows without text or lang teach nothing. About
    `docs_per_language` documents of each language are learned from, whole: those
    whose hashed id lies under that share of its labelled documents (all, if there
    are fewer). This is the bound on what reaches the driver. order: 7 at most.
    """
    labelled = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("doc_id", "text", "lang")
    rates = labelled.groupBy("lang").agg(F.least(F.lit(1.0), docs_per_language / F.count("*")).alias("rate"))
    sample = labelled.join(F.broadcast(rates), "lang").where(
        F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1_000_000)) < F.col("rate") * 1_000_000
    )

    def count(batches):
        for batch in batches:
            for part in chunks(batch):
                for lang in pc.unique(part.column("lang")).to_pylist():
                    texts = pc.fill_null(part.filter(pc.equal(part.column("lang"), lang)).column("text"), "")
                    keys, _ = windows(texts, order + 1)
                    for k in range(order + 1):
                        gram, n = np.unique(keys & np.uint64((1 << 8 * (k + 1)) - 1), return_counts=True)
                        yield pa.RecordBatch.from_pydict(
                            {
                                "lang": pa.array([lang] * len(gram), pa.string()),
                                "k": pa.array(np.full(len(gram), k, np.int32)),
                                "gram": pa.array(gram.view(np.int64)),
                                "n": pa.array(n),
                            }
                        )

    counted = (
        sample.mapInArrow(count, "lang string, k int, gram long, n long")
        .groupBy("lang", "k", "gram")
        .agg(F.sum("n").alias("n"))
        .toArrow()
    )
    languages = sorted(x for x in pc.unique(counted.column("lang")).to_pylist())
    parts: list[list[list[np.ndarray]]] = [[], [], [], [], []]
    for lang in languages:
        own = counted.filter(pc.equal(counted.column("lang"), lang))
        lists: list[list[np.ndarray]] = [[], [], [], [], []]
        for k in range(order + 1):
            rows = own.filter(pc.equal(own.column("k"), k))
            gram, n = rows.column("gram").to_numpy().view(np.uint64), rows.column("n").to_numpy()
            by = np.argsort(gram)
            gram, n = gram[by], n[by]
            context, first, kinds = np.unique(gram >> np.uint64(8), return_index=True, return_counts=True)
            for x, y in zip(lists, (gram, n, context, np.add.reduceat(n, first) if len(n) else n, kinds)):
                x.append(y)
        for x, y in zip(parts, lists):
            x.append(y)
    return PpmModel(languages, order, *parts)


def alphabet(model: PpmModel) -> np.ndarray:
    """Which of the 256 bytes any language has learned."""
    known = np.zeros(256, bool)
    for grams in model.grams:
        known[grams[0].astype(np.int64)] = True
    return known


def text_bits(model: PpmModel, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bits that each language's model takes for each text, the texts' bytes, and how many of these no language has learned."""
    keys, size = windows(texts, model.order + 1)
    coded = pa.array(keys).dictionary_encode()
    each, at = code_lengths(model, coded.dictionary.to_numpy()), coded.indices.to_numpy()
    text = np.repeat(np.arange(len(size)), size)
    new = np.bincount(text, ~alphabet(model)[(keys & np.uint64(255)).astype(np.int64)], len(size))
    return np.array([np.bincount(text, x[at], len(size)) for x in each]).reshape(len(model.languages), len(size)), size, new


#: Shorter texts, in bytes, are judged by nothing but whether they have a letter.
SHORT = 64


def unlearned_cost(docs: DataFrame, model: PpmModel, docs_per_language: int = 200) -> float | None:
    """The most bits a byte that a labelled text takes, lower-cased, when its own language's model is left out.

    It is what clean text may cost in a language that was not learned. Of each language
    `docs_per_language` texts of SHORT bytes and more count, those of smallest hashed
    id. None where fewer than two languages were learned.
    """
    if len(model.languages) < 2:
        return None
    shared = broadcast(docs.sparkSession, model)
    rows = docs.where(F.col("lang").isin(model.languages) & (F.octet_length("text") >= SHORT) & F.col("text").rlike(r"\p{L}"))
    first = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), F.xxhash64("text"))
    sample = rows.select("doc_id", "lang", F.lower("text").alias("text")).withColumn("_nth", F.row_number().over(first)).where(F.col("_nth") <= docs_per_language)

    def cost(batches):
        model = shared()
        for batch in batches:
            for part in chunks(batch, limit=2 << 20):
                bits, size, _ = text_bits(model, part.column("text"))
                own = [model.languages.index(x) for x in part.column("lang").to_pylist()]
                bits[own, np.arange(len(own))] = np.inf
                yield pa.RecordBatch.from_arrays([pa.array(bits.min(axis=0) / size)], names=["cost"])

    return sample.select("lang", "text").mapInArrow(cost, "cost double").agg(F.max("cost")).first()[0]


def unlike_text(docs: DataFrame, model: PpmModel, cut: float, new_bytes: float = 0.05) -> DataFrame:
    """Adds `unlike`: whether a text, lower-cased, takes more than `cut` bits a byte by every language, though its bytes are learned ones.

    Of texts shorter than SHORT bytes, and of those of whose bytes more than a share of
    `new_bytes` were never learned, such as another script's, nothing can be said: they
    are not unlike. Nor are null or empty texts.
    """
    shared, names = broadcast(docs.sparkSession, model), docs.columns

    def judge(batches):
        model = shared()
        for batch in batches:
            for part in chunks(batch, "_judged", limit=2 << 20):
                bits, size, new = text_bits(model, pc.fill_null(part.column("_judged"), ""))
                unlike = (size >= SHORT) & (new <= new_bytes * size) & (bits.min(axis=0) > cut * size)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(unlike)], names=[*names, "unlike"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.withColumn("_judged", F.lower("text")).mapInArrow(judge, f"{fields}, unlike boolean")


def identify(docs: DataFrame, model: PpmModel, keep: list[str] | None = None) -> DataFrame:
    """Adds lang_pred, score and bits_per_byte to the documents' columns, or to those named in `keep`.

    lang_pred is the language whose model codes the whole text in the fewest bits,
    ties to the name that sorts first; score is its posterior under equal priors,
    1 / sum over languages of 2^(fewest bits - its bits). A text that is null or holds
    no letter (as is an empty one), or a model that has learned nothing, gives `und`,
    score 0 and null bits_per_byte. Repeated rows are judged alike. Columns of the
    three names above are replaced. A task holds the code lengths of one chunk's
    distinct windows; texts never leave their partition.
    """
    kept = [c for c in keep or docs.columns if c not in ("lang_pred", "score", "bits_per_byte")]
    if not model.languages:
        return docs.select(*kept, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("bits_per_byte"))
    shared = broadcast(docs.sparkSession, model)

    def judge(batches):
        model = shared()
        for batch in batches:
            for part in chunks(batch, "_judged", limit=2 << 20):
                keys, size = windows(pc.fill_null(part.column("_judged"), ""), model.order + 1)
                coded = pa.array(keys).dictionary_encode()
                each = code_lengths(model, coded.dictionary.to_numpy())
                at = coded.indices.to_numpy()
                text = np.repeat(np.arange(len(size)), size)
                bits = np.array([np.bincount(text, x[at], len(size)) for x in each])
                best = bits.argmin(axis=0)
                fewest = bits[best, np.arange(len(size))]
                score = 1 / np.exp2(np.maximum(fewest - bits, -1000)).sum(axis=0)
                und = size == 0
                names = np.array(model.languages, object)[best]
                names[und] = "und"
                yield pa.RecordBatch.from_arrays(
                    [
                        *[part.column(c) for c in kept],
                        pa.array(names, pa.string()),
                        pa.array(np.where(und, 0.0, score)),
                        pa.array(fewest / np.maximum(size, 1), mask=und),
                    ],
                    names=[*kept, "lang_pred", "score", "bits_per_byte"],
                )

    text = F.when(F.col("text").rlike(r"\p{L}"), F.col("text"))
    rows = docs.select(*kept, text.alias("_judged"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema)
    return rows.mapInArrow(judge, f"{fields}, lang_pred string, score double, bits_per_byte double")


def held_out(column: str = "doc_id"):
    return crc_of_id(column) % 4 == 2


def op9_language(spark, sf_dir: str) -> DataFrame:
    """Every document's language by models of those that are not held out; see identify() for nulls, texts without letters and repeats."""
    docs = load(spark, sf_dir, "documents")
    model = train(docs.where(~held_out()))
    rows = docs.select("doc_id", "text", held_out().alias("held_out"))
    return identify(rows, model, keep=["doc_id", "held_out"])
