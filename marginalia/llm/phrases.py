"""Collocations by dynamic itemset counting: phrases of 2 to 4 words that are frequent, scored by how their parts keep company.

The corpus lies in `shards` tables, which are scanned in a cycle. In the first cycle words are counted. A longer phrase is
counted from the scan after the one in which both its subphrases (all words but the last, all but the first) have come to
`least` occurrences so far, for one whole cycle, so lengths mix in one scan. The scans end when a whole cycle has brought
no new subphrase.

A scan counts in Arrow batches, part by part of the text; places are found by numpy, phrases are counted by their bytes. Which subphrases have come so far is broadcast as two bit tables of at most 16 MB each, whatever their
number. A phrase that passes them by chance is counted too and does no harm: of each phrase the counts of the last `shards`
scans are held, which are of different shards, so their sum is never above the true count; it is the true count after a whole
cycle, and every frequent phrase has one, as its subphrases are frequent. The greatest sum that is seen is its count.
Counts are summed per task before they travel, so a frequent phrase is no hot key. Scores are decimals of 38 digits.

Defined results: a null text is empty; a null language is `und`; ties as the contract has them; equal rows count each; very
long texts are counted in parts of bounded size that overlap by the words a phrase needs; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import MOST_BITS, Scratch, slices, table, texts_of, written

LEAST, WORDS, SHARDS, TOP, SHARE = 30, 4, 2, 2000, 80
PART = 4_000_000  # bytes of text that are counted at once
COUNTS = "key string, n long"  # key: a phrase, a tab, which no word has, and the language
MIX, STEP = np.uint64(0x9E3779B97F4A7C15), 0x2545F4914F6CDD1D  # odd numbers
LONE = b"\xff"  # stands where a piece ends: no byte of UTF-8
# the signs that end a piece become LONE, A-Z small letters, a tab a space
TO = bytes(LONE[0] if chr(c) in ".,;:!?\n\x0b\x0c\r" else c + 32 if 65 <= c <= 90 else 32 if c == 9 else c for c in range(256))


def spaced(texts: list[str]) -> bytes:
    """Texts as words with one space after each; LONE is a word of its own where a piece ends."""
    data = "\n".join(texts).encode().translate(TO).replace(LONE, b" \xff ") + b" "
    while b"  " in data:
        data = data.replace(b"  ", b" ")
    return data.lstrip(b" ")


def parts_of(data: bytes, size: int, more: int) -> Iterator[tuple[bytes, int]]:
    """Cut spaced text after words into (part, bytes of it that are its own): after these stand the words that a phrase
    beginning among them may reach."""
    begin = 0
    while begin < len(data):
        end = data.find(b" ", min(begin + size, len(data)) - 1) + 1
        ahead = end
        for _ in range(more):
            ahead = (data.find(b" ", ahead) + 1) or len(data)
        yield data[begin:ahead], end - begin
        begin = end


_powers: list[np.ndarray] = []


def powers(n: int) -> list[np.ndarray]:
    """The first n powers of STEP and of its inverse, kept in a worker as far as a part needs them."""
    if _powers and len(_powers[0]) >= n:
        return _powers
    made = []
    for base in (STEP, pow(STEP, -1, 1 << 64)):
        row = np.full(n, base, np.uint64)
        row[0] = 1
        made.append(np.multiply.accumulate(row, out=row))
    if n <= 2 * PART:
        _powers[:] = made
    return made


def word_hashes(data: np.ndarray, begins: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """A hash of each word by its bytes, of running sums: the sieve's only, no result hangs on it."""
    power, back = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.multiply(data, power[: len(data)], out=sums[1:])
    np.cumsum(sums, out=sums)
    out = (sums[ends] - sums[begins]) * back[begins] + np.uint64(seed)
    out ^= out >> np.uint64(31)
    out *= MIX
    return out ^ (out >> np.uint64(29))


def seed_of(lang: str) -> int:
    return int.from_bytes(lang.encode()[-7:], "little")


def longer(hash_: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of phrases with one more word."""
    return hash_ * MIX + word


def places(hash_: np.ndarray, words: int, bits: int) -> np.ndarray:
    """Where phrases of so many words stand in a bit table."""
    return ((hash_ ^ (hash_ >> np.uint64(29)) ^ np.uint64(words)) * MIX >> np.uint64(20)) & np.uint64(bits - 1)


def bit_tables(reached: DataFrame, count: int) -> tuple[np.ndarray, np.ndarray]:
    """A bit for each phrase (lang, words, phrase, fresh), 16 bits of room for each up to MOST_BITS; the second table has the
    fresh ones alone."""
    bits = 1 << min(max(16 * count, 1 << 16).bit_length(), MOST_BITS.bit_length() - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            by: dict[tuple[str, int, bool], list[str]] = {}
            for lang, words, phrase, fresh in zip(*(b.column(c).to_pylist() for c in ("lang", "words", "phrase", "fresh")), strict=True):
                by.setdefault((lang, words, fresh), []).append(phrase)
            for (lang, words, fresh), phrases in by.items():
                data = np.frombuffer((" ".join(phrases) + " ").encode(), np.uint8)
                ends = np.flatnonzero(data == 32)
                each = word_hashes(data, np.concatenate(([0], ends[:-1] + 1)), ends, seed_of(lang)).reshape(-1, words)
                hash_ = each[:, 0]
                for k in range(1, words):
                    hash_ = longer(hash_, each[:, k])
                at = places(hash_, words, bits)
                bit = (np.uint64(1) << (at & np.uint64(63))).view(np.int64)
                yield pa.record_batch([pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array(bit), pa.array(bit * fresh)], names=["word", "known", "fresh"])

    got = reached.select("lang", "words", "phrase", "fresh").mapInArrow(run, "word long, known long, fresh long").groupBy("word").agg(F.bit_or("known").alias("known"), F.bit_or("fresh").alias("fresh")).toArrow()
    out = np.zeros((2, bits // 64), np.uint64)
    for row, c in zip(out, ("known", "fresh"), strict=True):
        row[got["word"].to_numpy()] = got[c].to_numpy().view(np.uint64)
    return out[0], out[1]


def marked(bits: np.ndarray, hash_: np.ndarray, words: int) -> np.ndarray:
    at = places(hash_, words, len(bits) * 64)
    return (bits[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def counted(lang: str, data: bytes, lengths: set[int], count_words: bool, known: np.ndarray | None, fresh: np.ndarray | None, size: int = PART) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """(phrases, counts) of a spaced text: words if wanted, and phrases of the lengths whose two subphrases are known and one
    of them fresh, as far as the bit tables tell."""
    longest = max(lengths, default=1)
    for part, own in parts_of(data, size, longest - 1):
        buffer = np.frombuffer(part, np.uint8)
        ends = np.flatnonzero(buffer == 32)
        begins = np.concatenate(([0], ends[:-1] + 1))
        n_own = int(np.searchsorted(ends, own))
        if count_words:
            offsets = pa.py_buffer(np.concatenate((begins[:n_own], [own])).astype(np.int32))
            yield from summed(pa.Array.from_buffers(pa.binary(), n_own, [None, offsets, pa.py_buffer(part)]))
        if not lengths:
            continue
        word = word_hashes(buffer, begins, ends, seed_of(lang))
        sub, whole = word, buffer[begins] != LONE[0]  # the hashes of the phrases of the length before, by their place
        words = whole
        for k in range(2, longest + 1):
            room = len(word) - k + 1
            if room <= 0:
                break
            whole = whole[:room] & words[k - 1 :]
            if k in lengths:
                at = np.flatnonzero(whole[:n_own])
                new = marked(fresh, sub[: n_own + 1], k - 1)
                at = at[new[at] | new[np.minimum(at + 1, len(new) - 1)]]
                at = at[marked(known, sub[at], k - 1)]
                at = at[marked(known, sub[at + 1], k - 1)]
                if len(at):
                    yield from summed(pa.array([part[i:j] for i, j in zip(begins[at].tolist(), (ends[at + k - 1] + 1).tolist(), strict=True)], pa.binary()))
            if k < longest:
                sub = longer(sub[:room], word[k - 1 :])


def summed(phrases: pa.Array) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Each phrase once, without the space at its end, and how often it is there; not LONE."""
    coded = phrases.dictionary_encode()
    n = np.bincount(coded.indices.to_numpy(), minlength=len(coded.dictionary))
    names = pc.binary_slice(coded.dictionary, 0, -1)
    keep = pc.not_equal(names, LONE)
    yield names.filter(keep), n[keep.to_numpy(zero_copy_only=False)]


def scan(shard: DataFrame, lengths: set[int], count_words: bool, tables: tuple[np.ndarray, np.ndarray] | None) -> DataFrame:
    """(key, n) of a shard, not yet summed."""
    shared = shard.sparkSession.sparkContext.broadcast(tables) if tables else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, fresh = shared.value if shared else (None, None)
        for batch in slices(batches, 100_000, PART):
            by: dict[str, list[str]] = {}
            for lang, text in zip(texts_of(batch, "lang"), texts_of(batch), strict=True):
                by.setdefault(lang, []).append(text)
            for lang, texts in by.items():
                for phrases, n in counted(lang, spaced(texts), lengths, count_words, known, fresh):
                    for i in range(0, len(phrases), 50_000):
                        key = pc.binary_join_element_wise(phrases[i : i + 50_000], lang.encode(), b"\t").cast(pa.string())
                        yield pa.record_batch([key, pa.array(n[i : i + 50_000].astype(np.int64))], names=["key", "n"])

    return shard.mapInArrow(run, COUNTS)


def phrase_of(key: Column) -> Column:
    return F.substring_index(key, "\t", 1)


def told(rows: DataFrame) -> DataFrame:
    """rows with lang, words and phrase in place of the key."""
    phrase = phrase_of(F.col("key"))
    lang = F.substr("key", F.length(phrase) + 2)
    words = F.length(phrase) - F.length(F.replace(phrase, F.lit(" "), F.lit(""))) + 1
    return rows.select(lang.alias("lang"), words.alias("words"), phrase.alias("phrase"), *(c for c in rows.columns if c != "key"))


def first_words(phrase: Column, words: Column) -> Column:
    return F.call_function("substring_index", phrase, F.lit(" "), words)


def last_words(phrase: Column, words: Column) -> Column:
    return F.call_function("substring_index", phrase, F.lit(" "), -words)


def frequent_phrases(docs: DataFrame, keep: Scratch, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = WORDS, shards: int = SHARDS) -> tuple[DataFrame, DataFrame]:
    """(lang, words, phrase, n) of all words and phrases with n >= least, and (lang, n) of all words; by dynamic counting."""
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)).cast("int").alias("shard"))
    rows = keep(rows, "phrase-shards", "shard")
    # state: counts of the last scans, n0 of the latest; found: what has come to least, n: the greatest sum, reached: in which scan
    ages = [f"n{i}" for i in range(shards)]
    names = ["lang", "words", "phrase"]
    state = found = totals = None
    step, last, before = 0, shards - 1, Scratch(docs.sparkSession)
    latest: dict[int, tuple[int, int]] = {}  # by words: how many have come, and in which scan the last one
    while step <= last:
        now, tables = Scratch(docs.sparkSession), None
        lengths = {k + 1 for k, (_, at) in latest.items() if at >= step - shards}
        if lengths:
            tables = bit_tables(found.where(F.col("words") < longest).withColumn("fresh", F.col("reached") >= step - shards), sum(n for n, _ in latest.values()))
        new = scan(rows.where(F.col("shard") == step % shards).select("lang", "text"), lengths, step < shards, tables)
        new = new.select("key", F.col("n").alias("n0"), *(F.lit(0).cast("long").alias(x) for x in ages[1:]))
        if state is not None and shards > 1:
            older = state.where(" + ".join(ages[:-1]) + " > 0").select("key", F.lit(0).cast("long").alias("n0"), *(F.col(x).alias(y) for x, y in zip(ages, ages[1:], strict=False)))
            new = new.unionByName(older)
        state = now(new.groupBy("key").agg(*(F.sum(x).alias(x) for x in ages)), "phrase-counts")
        total = sum((F.col(x) for x in ages[1:]), F.col(ages[0]))
        if step == shards - 1:
            words = state.where(~phrase_of(F.col("key")).contains(" ")).select("key", total.alias("n"))
            totals = keep(told(words).groupBy("lang").agg(F.sum("n").alias("n")), "phrase-totals")
        come = told(state.select("key", total.alias("n")).where(F.col("n") >= least)).withColumn("reached", F.lit(step))
        if found is not None:
            come = come.unionByName(found).groupBy(*names).agg(F.max("n").alias("n"), F.min("reached").alias("reached"))
        found = now(come, "phrase-found")
        latest = {r[0]: (r[1], r[2]) for r in found.where(F.col("words") < longest).groupBy("words").agg(F.count("*"), F.max("reached")).collect()}
        last = max(shards - 1, *(at + shards for _, at in latest.values())) if latest else shards - 1
        with before:  # the tables of the scan before go
            before, step = now, step + 1
    keep.paths += before.paths
    return found.select("lang", "words", "phrase", "n"), totals


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = WORDS, shards: int = SHARDS, top: int = TOP, share: int = SHARE) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first `top` phrases; op12 says what they mean."""
    with Scratch(docs.sparkSession) as keep:
        counts, totals = frequent_phrases(docs, keep, text, lang, least, longest, shards)
        counts = keep(counts, "phrase-frequent")
        long = counts.where("words > 1")
        cuts = long.select("lang", "phrase", "words", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
        cuts = cuts.withColumn("first", first_words(F.col("phrase"), F.col("k"))).withColumn("rest", last_words(F.col("phrase"), F.col("words") - F.col("k")))
        left, right = counts.select(F.col("lang").alias("ll"), F.col("phrase").alias("lp"), F.col("n").alias("l")), counts.select(F.col("lang").alias("rl"), F.col("phrase").alias("rp"), F.col("n").alias("r"))
        cuts = cuts.join(left, (cuts["lang"] == left["ll"]) & (cuts["first"] == left["lp"])).join(right, (cuts["lang"] == right["rl"]) & (cuts["rest"] == right["rp"]))
        exact = F.col("a").cast("decimal(20,0)") * F.lit(2_000_000).cast("decimal(8,0)")
        score = F.expr("cast(x div y as long)")
        cuts = cuts.withColumn("x", exact.cast("decimal(38,0)")).withColumn("y", (F.col("l").cast("decimal(20,0)") + F.col("r").cast("decimal(20,0)")).cast("decimal(38,0)")).withColumn("score", score)
        best = cuts.groupBy("lang", "phrase", "words").agg(F.min(F.struct("score", "k", "l", "r", "a")).alias("cut")).select("lang", "phrase", "words", "cut.score", "cut.l", "cut.r", "cut.a")
        words = F.split("phrase", " ")
        inside = F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda w: F.transform(F.sequence(F.lit(1), F.col("words") - w + 1), lambda i: F.array_join(F.slice(words, i, w), " "))))
        longer = long.where("words > 2").select("lang", "n", F.explode(inside).alias("phrase")).groupBy("lang", "phrase").agg(F.max("n").alias("longer")).toDF("ol", "op", "longer")
        kept = best.join(longer, (best["lang"] == longer["ol"]) & (best["phrase"] == longer["op"]), "left")
        wide = lambda c, by: F.col(c).cast("decimal(20,0)") * F.lit(by).cast("decimal(5,0)")
        kept = kept.where(F.col("longer").isNull() | (wide("longer", 100) < wide("a", share))).select("lang", "phrase", "a", "l", "r", "score")
        # first the best of each of many parts, then the best of these: no task ranks a whole language
        order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
        kept = kept.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(64)).cast("int"))
        kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
        kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
        out = kept.join(totals.toDF("tl", "n"), F.col("lang") == F.col("tl")).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
        return written(out, "phrases")


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), w AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p
), g AS (
  SELECT lang, k AS words, unnest(list_transform(range(1, greatest(len(ws) - k + 2, 1)), lambda i: array_to_string(list_slice(ws, i, i + k - 1), ' '))) AS phrase
  FROM w CROSS JOIN (VALUES (1), (2), (3), (4)) x(k)
), f AS MATERIALIZED (
  SELECT lang, words, phrase, count(*) AS n FROM g GROUP BY ALL
), t AS (
  SELECT lang, sum(n)::BIGINT AS n FROM f WHERE words = 1 GROUP BY lang
), c AS MATERIALIZED (
  SELECT lang, words, phrase, n AS a, string_split(phrase, ' ') AS ws FROM f WHERE words > 1 AND n >= 30
), parts AS MATERIALIZED (
  SELECT lang, phrase, a, k, array_to_string(ws[:k], ' ') AS one, array_to_string(ws[k + 1:], ' ') AS two FROM c CROSS JOIN (VALUES (1), (2), (3)) x(k) WHERE k < words
), cut AS (
  SELECT c.lang, c.phrase, a, l.n AS l, r.n AS r, (2000000::HUGEINT * a // (l.n + r.n))::BIGINT AS score, k
  FROM parts c JOIN f l ON l.lang = c.lang AND l.phrase = one JOIN f r ON r.lang = c.lang AND r.phrase = two
), best AS (
  SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inner_ AS (
  SELECT lang, phrase, max(a) AS longer FROM (
    SELECT lang, a, unnest(list_transform(range(1, greatest(words - k + 2, 1)), lambda i: array_to_string(list_slice(ws, i, i + k - 1), ' '))) AS phrase FROM c CROSS JOIN (VALUES (2), (3)) x(k) WHERE k < words
  ) GROUP BY 1, 2
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, t.n, score
FROM best LEFT JOIN inner_ USING (lang, phrase) JOIN t USING (lang) WHERE longer IS NULL OR 100::HUGEINT * longer < 80::HUGEINT * a
QUALIFY rank <= 2000
"""
