"""Search for instruments by keyword: a scan for one, an index of trigrams for many."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import kept

FIELDS = ("symbol", "name")
#: Characters of all keywords up to which these are broadcast to the postings; more are joined by shuffles.
SENT = 1 << 20


def search(instruments: DataFrame, keyword: str, most: int = 20) -> DataFrame:
    """Up to `most` instruments (symbol, name, market) whose symbol or name contains the keyword, in the order of symbols."""
    hit = F.col("symbol").contains(keyword) | F.col("name").contains(keyword)
    return instruments.where(hit).orderBy("symbol").limit(most)


def trigrams(text: Column) -> Column:
    """The distinct runs of three characters; none for shorter or null texts."""
    places = F.when(F.length(text) >= 3, F.sequence(F.lit(1), F.length(text) - 2))
    return F.coalesce(F.array_distinct(F.transform(places, lambda i: F.substr(text, i, F.lit(3)))), F.array().cast("array<string>"))


def trigram_index(instruments: DataFrame) -> DataFrame:
    """(gram, field, symbol, name): the postings of each trigram of a symbol or a name, with the texts that they are verified by."""
    fields = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in FIELDS]))
    rows = instruments.select("symbol", "name", fields.alias("f"))
    return rows.select(F.explode(trigrams(F.col("f.value"))).alias("gram"), "f.field", "symbol", "name")


def looked_up(asked: DataFrame, postings: DataFrame, key: str) -> DataFrame:
    """The rows of `asked` (keyword, ...), a table of files, with the postings of their key.

    Spark takes postings for as small as the file that they are exploded from, and would
    broadcast them; so only what is asked for is ever broadcast, up to SENT characters.
    """
    few = (asked.agg(F.sum(F.length("keyword").cast("long"))).first()[0] or 0) <= SENT
    return postings.join(F.broadcast(asked), key) if few else postings.hint("merge").join(asked, key)


def candidates(index: DataFrame, keywords: DataFrame) -> DataFrame:
    """(keyword, symbol, name, field) whose postings hold every trigram of the keyword; a keyword's rarest gram is read first.

    Each keyword is joined to the postings of its rarest trigram alone, the shortest
    list, and the others are looked for in the text found, so common trigrams' long lists
    are not read for it. Each keyword's rarest gram is kept in the shared folder.
    """
    counts = index.groupBy("gram").agg(F.count("*").alias("postings"))
    grams = keywords.select("keyword").distinct().where(F.length("keyword") >= 3).select("keyword", F.explode(trigrams(F.col("keyword"))).alias("gram"))
    rarest = grams.join(counts, "gram", "left").groupBy("keyword").agg(
        F.min_by("gram", F.struct(F.coalesce("postings", F.lit(0)), "gram")).alias("gram"), F.collect_set("gram").alias("all")
    )
    found = looked_up(kept(rarest), index, "gram")
    text = F.when(F.col("field") == FIELDS[0], F.col("symbol")).otherwise(F.col("name"))
    return found.where(F.forall("all", lambda g: F.contains(text, g))).select("keyword", "symbol", "name", "field")


def search_many(instruments: DataFrame, keywords: DataFrame) -> DataFrame:
    """(keyword, symbol, name): every instrument that contains a keyword, for each distinct keyword.

    Keywords of three characters and more are answered from the trigram index, and its
    candidates verified; shorter ones, of which there are few, by a scan for each. Null
    or empty keywords find nothing.
    """
    indexed = candidates(trigram_index(instruments), keywords)
    text = F.when(F.col("field") == FIELDS[0], F.col("symbol")).otherwise(F.col("name"))
    long = indexed.where(F.contains(text, F.col("keyword"))).select("keyword", "symbol", "name").distinct()
    grams = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length("v") - (n - 1), F.lit(1))), lambda i: F.substr(F.col("v"), i, F.lit(n)))
    # One or two characters: their own postings, built for the lengths that are asked for.
    values = instruments.select("symbol", "name", F.explode(F.array(*FIELDS)).alias("v")).where("v IS NOT NULL")
    short = values.select("symbol", "name", F.explode(F.array_distinct(F.concat(grams(1), grams(2)))).alias("keyword"))
    asked = kept(keywords.select("keyword").distinct().where(F.length("keyword").between(1, 2)))
    return long.unionByName(looked_up(asked, short, "keyword").select("keyword", "symbol", "name").distinct())
