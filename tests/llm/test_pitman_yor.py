import math
import os
import random
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import xxhash

from pyspark import SparkContext
from pyspark.sql import functions as F

from tickforge.llm import pitman_yor
from tickforge.llm.pitman_yor import END, RARE, held_out, op1_pitman_yor, score, train
from tickforge.llm.seating import EXACT, Tables, gammas, uniforms

from .helpers import crc, documents, words

ROWS = [(i, t) for i, t in enumerate(["a b a b c", "A b a d", None, "", "the a b", "x y z a b a b", "é É e", "a " * 150, "b a", "a b a b c", "q r s t u v " * 40])]


def tokens(t):
    return [*words(t), b"\n"]


def test_scores_are_the_models_probabilities(spark):
    for ranked in (3, 1000):
        model = train(documents(spark, ROWS), burn_in=1, samples=2, ranked_words=ranked)
        hashes = {w: xxhash.xxh3_64_intdigest(w) if w != b"\n" else END for _, t in ROWS for w in tokens(t)}
        ranks = dict(zip(model.ranks.hashes.tolist(), model.ranks.rank.tolist()))
        key = lambda w: ranks.get(hashes[w], (int(hashes[w]) | int(RARE)) - (1 << 64))
        counts = Counter(w for _, t in ROWS for w in tokens(t))
        total = sum(counts.values())
        assert len(ranks) <= ranked and (len(ranks) == len(counts)) == (ranked == 1000)
        pairs = Counter(x for _, t in ROWS for x in zip([b"\n", *tokens(t)], tokens(t)))
        cells = {(r.h, r.w): r for r in model.cells.collect()}
        rooms = {r.h: r for r in model.restaurants.collect()}
        roots = {r.w: r for r in model.roots.collect()}
        assert {k: r.n for k, r in cells.items()} == {(key(h), key(w)): n for (h, w), n in pairs.items()}
        assert {k: r["count"] for k, r in roots.items()} == {key(w): n for w, n in counts.items()} and model.train_tokens == total
        for h in rooms:
            own = [r for (x, _), r in cells.items() if x == h]
            assert rooms[h].customers == sum(r.n for r in own) and sum(rooms[h].sampled) == sum(r.tables for r in own)
            assert all(2 * (r.n > 0) <= r.tables <= 2 * r.n for r in own)
        for w in roots:
            assert sum(roots[w].sampled) == sum(r.tables for (_, x), r in cells.items() if x == w)
        assert model.root_customers == [sum(r.sampled[s] for r in roots.values()) for s in range(2)]
        d, d0, c = model.discount, model.root_discount, model.concentration

        def chance(h, w):
            out = 0
            for s in range(2):
                top = (roots[w].sampled[s] - d0 if w in roots else c + d0 * len(roots)) / (c + model.root_customers[s])
                out += top if h not in rooms else (c + d * rooms[h].sampled[s]) / (c + rooms[h].customers) * top
            cell = cells.get((h, w))
            return out / 2 + ((cell.n - d * cell.tables / 2) / (c + rooms[h].customers) if cell else 0)

        for h in [*rooms, None]:
            assert math.isclose(sum(chance(h, w) for w in [*roots, None]), 1, rel_tol=1e-9)
        asked = ROWS + [(50, "never a b never c"), (None, "q"), (1, "A b a d"), (51, "new " * 30)]
        for dense, passes in ((2, 2), (1000, 1)):
            got = sorted(
                (r.doc_id if r.doc_id is not None else -1, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6))
                for r in score(documents(spark, asked), model, {"doc_id": F.col("doc_id")}, dense_pairs=dense, passes=passes).collect()
            )
            want = []
            for i, t in asked:
                ws = tokens(t)
                of = [key(w) if w in counts else None for w in ws]
                base = sum(math.log10((counts[w] + 1) / (total + len(counts) + 1)) for w in ws)
                mine = sum(math.log10(chance(h, w)) for h, w in zip([key(b"\n"), *of[:-1]], of))
                want.append((-1 if i is None else i, len(ws), sum(w in counts for w in ws), total, round(base, 6), round(mine, 6)))
            assert got == sorted(want)


def law(n, discount, weight):
    """P(t) by adding up what every way to seat n customers weighs, customer by customer, in fractions."""
    discount, state = Fraction(discount).limit_denominator(1000), {(1,): Fraction(1)}
    for _ in range(n - 1):
        new = defaultdict(Fraction)
        for sizes, x in state.items():
            new[tuple(sorted((*sizes, 1)))] += x
            for i, size in enumerate(sizes):
                new[tuple(sorted((*sizes[:i], size + 1, *sizes[i + 1 :])))] += x * (size - discount)
        state = new
    out = np.zeros(n + 1)
    for sizes, x in state.items():
        out[len(sizes)] += float(x) * weight ** len(sizes)
    return out / out.sum()


def test_tables_follow_the_exact_law():
    draws = 40_000
    key = np.arange(draws, dtype=np.uint64)
    for d in (0.25, 0.8):
        tables = Tables(d)
        for n, weight in ((2, 0.3), (3, 1.0), (8, 0.2), (8, 3.0), (14, 0.9)):
            t = tables.draw(np.full(draws, n), np.full(draws, weight), uniforms(key, n, 1), uniforms(key, n, 2))
            assert np.abs(np.bincount(t, minlength=n + 1) / draws - law(n, d, weight)).max() < 4 * 0.5 / math.sqrt(draws)
        # Both ways to the law, where they meet.
        t = np.arange(1, EXACT + 1.0)
        for weight in (0.01, 1, 30, 3000, 1e5):
            p = tables.log_s[EXACT, 1:] + np.log(weight) * t
            q = tables.log_law(np.full(EXACT, float(EXACT)), t, np.full(EXACT, np.log(weight)))
            p, q = (np.exp(x - x.max()) / np.exp(x - x.max()).sum() for x in (p, q))
            assert np.abs(p - q).sum() / 2 < 0.006
            m = 3000
            got = tables.draw(np.full(m, EXACT + 1), np.full(m, weight), uniforms(key[:m], 7), uniforms(key[:m], 8))
            mean, spread = (p * t).sum(), math.sqrt((p * t * t).sum() - (p * t).sum() ** 2)
            assert abs(got.mean() - mean) < 5 * spread / math.sqrt(m) + 0.002 * mean
        assert (tables.draw(np.array([1, 10**9, 10**12]), np.array([5.0, 1e-9, 100.0]), np.full(3, 0.5), np.full(3, 0.5)) >= 1).all()


def test_gammas_have_their_moments():
    key = np.arange(50_000, dtype=np.uint64)
    for shape in (0.2, 1.0, 7.5):
        x = gammas(np.full(len(key), shape), key, 3)
        assert abs(x.mean() - shape) < 5 * math.sqrt(shape / len(key)) and abs(x.var() - shape) < 0.06 * shape + 0.02
    assert 0 < uniforms(key, 1).min() and abs(uniforms(key, 1).mean() - 0.5) < 0.01


def reseated(pairs, d, d0, c, sweeps, rng):
    """Mean number of all restaurants' tables, by taking single customers away and seating them again."""
    seats = {k: [] for k in pairs}
    rooms, root = Counter(), Counter()

    def add(h, w):
        size = seats[h, w]
        top = (root[w] - d0) / (c + sum(root.values())) if root[w] else (c + d0 * sum(x > 0 for x in root.values())) / (c + sum(root.values()))
        weights = [*(s - d for s in size), (c + d * rooms[h]) * top]
        i = rng.choices(range(len(weights)), weights)[0]
        if i == len(size):
            size.append(1)
            rooms[h] += 1
            root[w] += 1
        else:
            size[i] += 1

    customers = [k for k, n in pairs.items() for _ in range(n)]
    for k in customers:
        add(*k)
    means = []
    for _ in range(sweeps):
        for h, w in customers:
            size = seats[h, w]
            i = rng.choices(range(len(size)), size)[0]
            size[i] -= 1
            if not size[i]:
                del size[i]
                rooms[h] -= 1
                root[w] -= 1
            add(h, w)
        means.append(sum(rooms.values()))
    return np.array(means[sweeps // 10 :])


def test_sweeps_sample_what_single_customers_do(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice("aaaabbbccdefgh") for _ in range(12)) for _ in range(40)]
    model = train(documents(spark, list(enumerate(texts)), extra=False), burn_in=2, samples=8)
    pairs = Counter(x for t in texts for x in zip([b"\n", *tokens(t)], tokens(t)))
    want = reseated(pairs, model.discount, model.root_discount, model.concentration, 400, rng)
    got = np.array(model.root_customers)
    assert abs(got.mean() - want.mean()) < 4 * want.std() / math.sqrt(len(got)) and 0.3 < got.std() / want.std() < 2


def test_nothing_to_learn_or_score(spark):
    model = train(documents(spark, []))
    (r,) = score(documents(spark, [(1, "a")]), model, {"doc_id": F.col("doc_id")}).collect()
    assert (r.n_tokens, r.n_known, r.train_tokens) == (2, 0, 0) and math.isclose(r.score, 0, abs_tol=1e-9)
    assert score(documents(spark, []), model, {"doc_id": F.col("doc_id")}).collect() == []


def test_a_very_long_text_and_kept_columns_of_clashing_names(spark):
    rows = [(1, "to be or not to be that is " * 250_000), (2, "to be"), (3, None)]
    docs = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in rows], "doc_id long, text string, row int, h int, kind int")
    got = {r.doc_id: r for r in score(docs.drop("x"), train(docs, burn_in=0, samples=1), {c: F.col(c) for c in ("doc_id", "row", "h", "kind")}).collect()}
    assert {i: r.n_tokens for i, r in got.items()} == {1: 2_000_001, 2: 3, 3: 1} and all((r.row, r.h, r.kind) == (1, 2, 3) for r in got.values())
    assert got[1].score > got[1].base_score


def test_query_beats_the_base_on_held_out_texts(spark):
    d = "/root/testdata/sf0.01"
    got = op1_pitman_yor(spark, d).collect()
    assert len(got) == spark.read.parquet(f"{d}/documents.parquet").count()
    assert all(r.held_out == (crc(r.doc_id) % 7 == 2) for r in got)
    mine, base = (sum(getattr(r, c) for r in got if r.held_out) / sum(r.n_tokens for r in got if r.held_out) for c in ("score", "base_score"))
    assert mine > base + 1 and mine > -2.8
    assert documents(spark, [(None, "a")]).select(held_out().alias("h")).first().h is False


def test_pairs_that_are_scored_leave_the_disk(spark, monkeypatch):
    """Of the four kinds of pairs those that are summed up are deleted before the next is joined."""
    docs = documents(spark, ROWS)
    model = train(docs, burn_in=0, samples=1, ranked_words=3)
    kept, seen = pitman_yor.saved, []

    def watched(df, partition_by=None):
        out = kept(df, partition_by)
        if partition_by == "kind":
            seen.append((out.kept_at.removeprefix("file:"), []))
        elif seen and os.path.isdir(seen[-1][0]):
            seen[-1][1].append({x[5:] for x in os.listdir(seen[-1][0]) if x.startswith("kind=")})
        return out

    monkeypatch.setattr(pitman_yor, "saved", watched)
    got = score(docs, model, {"doc_id": F.col("doc_id")}, dense_pairs=0, passes=1)
    assert got.count() == docs.count()
    ((_, kinds),) = seen
    assert kinds[0] == {"-1", "0", "1", "2", "3"} and {"-1", "3"} in kinds and kinds[-1] == {"-1"}


def test_texts_are_tokenised_once_and_common_pairs_are_folded(spark, monkeypatch):
    """Turns don't read the texts again, and pairs of ranked tokens go to their cells by shard, not by place."""
    rows = [(i, "a b a b c d e f " * 50) for i in range(40)]
    docs = documents(spark, rows).coalesce(1)
    model = train(docs, burn_in=0, samples=1)
    kept, seen = pitman_yor.saved, []

    def watched(df, partition_by=None):
        out = kept(df, partition_by)
        if partition_by == "kind":
            seen.append(out.where("kind = 0").count())
        return out

    monkeypatch.setattr(pitman_yor, "saved", watched)
    got = score(docs, model, {"doc_id": F.col("doc_id")}, dense_pairs=0).collect()
    assert seen == [1] and len(got) == len(rows) and len({round(r.score, 6) for r in got}) == 1 and got[0].n_tokens == 401


def test_pairs_beside_a_rare_token_are_folded_and_ranked_pairs_go_in_turns(spark, monkeypatch):
    """Only pairs of two rare tokens are rows; shards of ranked pairs are met in turns; broadcasts are deleted."""
    docs = documents(spark, [(i, f"a b c d e f g r{i} a c e g b d s{i} t{i} " * 9) for i in range(20)]).coalesce(1)
    kept, cast, seen, held = pitman_yor.saved, SparkContext.broadcast, [], []

    def watched(df, partition_by=None):
        out = kept(df, partition_by)
        if partition_by == "kind":
            seen.append({r.kind: r["count"] for r in out.groupBy("kind").count().collect()})
        return out

    monkeypatch.setattr(pitman_yor, "saved", watched)
    monkeypatch.setattr(pitman_yor, "SHARD", 512)
    monkeypatch.setattr(SparkContext, "broadcast", lambda self, value: held.append(cast(self, value)) or held[-1])
    model = train(docs, burn_in=0, samples=1, ranked_words=8)
    got = [{r.doc_id: (r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in score(docs, model, {"doc_id": F.col("doc_id")}, dense_pairs=0, passes=n).collect()} for n in (1, 2)]
    assert got[0] == got[1] and len(got[0]) == docs.count() and model.shards > 2
    assert set(seen[0]) == {-1, 0, 1, 2, 3} and set(seen[1]) == {-1, 0, 1, 2, 3, 4} and seen[0][0] == seen[1][0] + seen[1][4]
    assert all(x[k] <= model.shards < 20 * 9 <= x[3] for x in seen for k in (1, 2))
    assert held and not any(os.path.exists(x._path) for x in held)


def test_tokens_are_counted_in_blocks(spark, monkeypatch):
    docs = documents(spark, [(i, f"a b x{i}") for i in range(30)], extra=False)
    monkeypatch.setattr(pitman_yor, "COUNTED", 5)
    blocks = pitman_yor.count_tokens(docs).toArrow()
    counts = Counter(w for i in range(30) for w in tokens(f"a b x{i}"))
    found = dict(zip(pitman_yor.opened(blocks.column("w"), np.uint64).tolist(), pitman_yor.opened(blocks.column("n")).tolist()))
    assert blocks.num_rows == 5 and found == {xxhash.xxh3_64_intdigest(w) if w != b"\n" else END: n for w, n in counts.items()}
