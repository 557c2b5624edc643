"""Near-duplicate documents by improved consistent weighted sampling over TF-IDF shingles.

A document is a weighted set: its shingles of five words (lower-cased; a shorter text is one shingle), each weighing its
count times its inverse document frequency. For each of ``bands * rows`` samples, improved consistent weighted
sampling (Ioffe) draws from a weight S, with r, c ~ Gamma(2, 1) and b ~ U(0, 1) fixed for the shingle,
``t = floor(ln S / r + b)`` and keeps the shingle with least ``ln c - r (t - b + 1)``, together with t: two documents
draw alike with the probability of their weighted Jaccard similarity. Documents with one band alike are candidates if
enough of all their samples agree too (four bits of each are compared); each candidate pair is verified by its exact
weighted Jaccard similarity on the texts.

Document frequencies are shares of all documents. They are counted in a count-min sketch (two rows of hashed cells, one size
at any scale) and told apart down to a share of one in ``rarest``; whatever is rarer weighs the same. What the sketch
counts too much is a share as well (the shingles of a mean document over the cells of a row), so a shingle
weighs alike in a small and in a large corpus.

Groups are classes of documents joined by links of at least ``threshold``. No pairs are made within a group:

1. texts that are equal word for word are one text;
2. in each band bucket the most central text leads. Every text is compared with one leader, the one of its buckets' whose
   samples agree best, so its text is fetched once;
3. what is still apart from others in its buckets is compared pair by pair, where masses and samples let a pair reach
   ``threshold``. Shingles that no other remaining text has are found first: they can't be shared. What is left
   of each text is added up in ``CLASSES`` hash classes of shingles; two texts share at most the lesser sum of each class, and
   pairs that this bound leaves below the threshold are not compared. Every remaining text is bounded so, however large its
   buckets: the work is a share of the input, not of what passes some size of bucket.

Any candidate pair is in one class at last or was judged itself. Buckets, groups and leaders that many rows share are dealt to
blocks (``block_counts``), so no task gets a whole crowd.

Defined results: null, empty and wordless texts are never linked, not even to each other; a text equal to another one
(up to case and white space) is in its class; the class's number is its least doc_id; doc_id is the key: rows that share
one are in one class, and a row without one is in the class of its text, or in none. Other columns play no part. Misses: a
pair at similarity 0.8 shares none of 12 bands of 3 with probability 0.0002, and fails the samples' test with 0.00001.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placewright.llm.bpe import utf8
from placewright.llm.repeats import Rolling, mix
from placewright.llm.staging import block_counts, block_join, staged, unused

#: Words remembered by a task; only speed depends on it.
REMEMBERED = 200_000
#: Quantiles of the random variables: a table that stays in a core's first cache.
STEPS = 1 << 12
#: Shingles drawn from at once.
BLOCK = 512
#: Sums of weights may differ so much in their last digits, so bounds give way by it.
SLACK = 1e-6
#: Hash classes of shingles in which texts are bounded before pairs are made.
CLASSES = 32


def gamma_quantiles() -> np.ndarray:
    """Quantiles of Gamma(2, 1) at the middles of STEPS equal shares: roots of 1 - (1 + x) exp(-x) = q, by bisection."""
    q = (np.arange(STEPS) + 0.5) / STEPS
    low, high = np.zeros(STEPS), np.full(STEPS, 40.0)
    for _ in range(60):
        mid = (low + high) / 2
        less = 1 - (1 + mid) * np.exp(-mid) < q
        low, high = np.where(less, mid, low), np.where(less, high, mid)
    return (low + high) / 2


class Shingler:
    """Distinct shingles of texts and their counts; word hashes are remembered within a task."""

    def __init__(self, size: int):
        self.size, self.known = size, {}

    def __call__(self, text: bytes) -> tuple[np.ndarray, np.ndarray, int]:
        words = text.decode("utf-8").lower().split()
        if not words:
            return np.zeros(0, np.uint64), np.zeros(0), 0
        if len(self.known) > REMEMBERED:
            self.known = {}
        known = self.known
        for w in [w for w in words if w not in known]:
            known[w] = xxhash.xxh3_64_intdigest(w.encode())
        codes = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
        rolling = Rolling(mix(codes))
        n = len(words)
        whole = int(rolling.stretch(np.array([0]), np.array([n]))[0] ^ mix(np.array([n], dtype=np.uint64))[0])
        grams = rolling.grams(self.size) if n >= self.size else np.array([whole], dtype=np.uint64)
        shingles, times = np.unique(grams, return_counts=True)
        return shingles, times.astype(float), whole


class Sampler:
    def __init__(self, samples: int):
        gamma = gamma_quantiles()
        self.r, self.log_c = gamma.astype(np.float32), np.log(gamma).astype(np.float32)
        self.seeds = (mix(np.arange(1, samples + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1))[:, None]
        self.rows = np.arange(samples)

    def __call__(self, shingles: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """One 64-bit number for each sample: what was drawn."""
        logs = np.log(weights).astype(np.float32)
        best = np.full(len(self.rows), np.inf, dtype=np.float32)
        drawn, level = np.zeros(len(self.rows), dtype=np.uint64), np.zeros(len(self.rows), dtype=np.float32)
        for start in range(0, len(shingles), BLOCK):
            own = shingles[start : start + BLOCK]
            x = own * self.seeds
            x ^= x >> np.uint64(32)
            x *= np.uint64(0x9FB21C651E98DF25)
            r = self.r.take((x >> np.uint64(52)).view(np.int64))
            score = self.log_c.take(((x >> np.uint64(36)) & np.uint64(STEPS - 1)).view(np.int64))
            b = ((x >> np.uint64(20)) & np.uint64(0xFFFF)).astype(np.float32)
            b *= np.float32(1 / 65536)
            t = logs[start : start + BLOCK] / r
            t += b
            np.floor(t, out=t)
            b -= t
            b -= 1
            b *= r
            score += b  # ln c - r (t - b + 1)
            i = score.argmin(axis=1)
            least = score[self.rows, i]
            new = least < best
            best = np.where(new, least, best)
            drawn, level = np.where(new, own[i], drawn), np.where(new, t[self.rows, i], level)
        return mix(drawn ^ mix(level.astype(np.int64).view(np.uint64)))


def cells_of(shingles: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the two rows of the sketch count each shingle."""
    half = np.uint64(cells // 2)
    return (shingles % half).astype(np.intp), ((mix(shingles) % half) + half).astype(np.intp)


def document_frequencies(docs: DataFrame, size: int, cells: int) -> tuple[np.ndarray, int]:
    """How many documents have a shingle in each of ``cells`` cells, and how many have any: tables of fixed size, summed
    by Spark in ``parts`` of the table."""
    parts, slots = 64, 256  # tables of tasks are added in two rounds, so no task gets many

    def count(batches):
        slot = TaskContext.get().partitionId() % slots
        cut = Shingler(size)
        seen, n = np.zeros(cells, dtype=np.int32), 0
        for batch in batches:
            for text in utf8(batch.column("text")):
                for own in cells_of(cut(text)[0], cells):
                    seen[own] += 1  # a document counts once in a cell, however many of its shingles are there
                n += len(own) > 0
        for i, part in enumerate(np.split(seen, parts)):
            yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([slot]), pa.array([np.ascontiguousarray(part, dtype=np.int64).tobytes()]), pa.array([n])], ["part", "slot", "seen", "n"])

    def add(key, given):
        total = np.zeros(cells // parts, dtype=np.int64)
        for seen in given.column("seen").to_pylist():
            total += np.frombuffer(seen, dtype=np.int64)
        n = sum(given.column("n").to_pylist())
        return pa.table({"part": pa.array([key[0].as_py()]), "slot": pa.array([0]), "seen": pa.array([total.tobytes()], pa.binary()), "n": pa.array([n])})

    kind = "part long, slot long, seen binary, n long"
    rows = docs.mapInArrow(count, kind).groupBy("part", "slot").applyInArrow(add, kind).groupBy("part").applyInArrow(add, kind).orderBy("part").collect()  # ``cells`` numbers, whatever the input
    if not rows:
        return np.zeros(cells, dtype=np.int64), 0
    return np.concatenate([np.frombuffer(bytes(r["seen"]), dtype=np.int64) for r in rows]), rows[0]["n"]


def idf(seen: np.ndarray, n: int, rarest: int) -> np.ndarray:
    """Weights by share of documents, from 1 (all of them) on; a share below 1 in ``rarest`` counts as that."""
    return (1 + np.log(n / np.clip(seen, max(n / rarest, 1), max(n, 1)))).astype(np.float32) if n else np.ones(len(seen), np.float32)


def weighed(shingles: np.ndarray, times: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The weight of each shingle: of its two cells the one that counts less is right, or nearer."""
    a, b = cells_of(shingles, len(table))
    return times * np.maximum(table[a], table[b])


def differences_allowed(samples: int, threshold: float, miss: float = 1e-5) -> int:
    """The least number of differing four-bit samples that a pair at ``threshold`` exceeds with probability below ``miss``."""
    p = (1 - threshold) * 15 / 16
    tail, most = 1.0, -1
    while tail >= miss:
        most += 1
        tail -= math.comb(samples, most) * p**most * (1 - p) ** (samples - most)
    return most


def code_names(samples: int) -> list[str]:
    return [f"code{i}" for i in range(-(-samples // 16))]


def packed_codes(drawn: np.ndarray) -> np.ndarray:
    """Four bits of each sample, sixteen samples to an integer."""
    bits = np.zeros(-(-len(drawn) // 16) * 16, dtype=np.uint64)
    bits[: len(drawn)] = drawn >> np.uint64(60)
    return (bits.reshape(-1, 16) << (np.arange(16, dtype=np.uint64) * np.uint64(4))).sum(axis=1, dtype=np.uint64).view(np.int64)


def differences(a: list[Column], b: list[Column]) -> Column:
    """How many four-bit samples differ."""
    total = F.lit(0)
    for x, y in zip(a, b, strict=True):
        z = x.bitwiseXOR(y)
        any_bit = z.bitwiseOR(F.shiftrightunsigned(z, 1)).bitwiseOR(F.shiftrightunsigned(z, 2)).bitwiseOR(F.shiftrightunsigned(z, 3))
        total = total + F.bit_count(any_bit.bitwiseAND(F.lit(0x1111111111111111)))
    return total


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum of minima over sum of maxima of two weighted sets with sorted keys."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = float(np.minimum(a[1][i], b[1][j]).sum())
    return both / (float(a[1].sum() + b[1].sum()) - both) if both else 0.0


def signatures(docs: DataFrame, table, size: int, bands: int, rows: int) -> DataFrame:
    """``doc_id, whole, mass, keys, code0...``: a hash of all words, the weight of all shingles, one key a band, and four bits
    of each sample."""
    names = code_names(bands * rows)

    def run(batches):
        cut, draw, weight = Shingler(size), Sampler(bands * rows), table.value
        powers = mix(np.arange(11, 11 + bands * rows, dtype=np.uint64)) | np.uint64(1)
        for batch in batches:
            wholes, masses, keys, codes = [], [], [], []
            for text in utf8(batch.column("text")):
                shingles, times, whole = cut(text)
                if not len(shingles):
                    for held in (wholes, masses, keys, codes):
                        held.append(None)
                    continue
                weights = weighed(shingles, times, weight)
                drawn = draw(shingles, weights)
                band = mix((drawn * powers).reshape(bands, rows).sum(axis=1, dtype=np.uint64) + np.arange(bands, dtype=np.uint64))
                wholes.append(np.uint64(whole).view(np.int64))
                masses.append(float(weights.sum()))
                keys.append(band.view(np.int64).tolist())
                codes.append(packed_codes(drawn).tolist())
            of_code = [pa.array([c and c[i] for c in codes], pa.int64()) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(wholes, pa.int64()), pa.array(masses, pa.float64()), pa.array(keys, pa.list_(pa.int64())), *of_code], ["doc_id", "whole", "mass", "keys", *names])

    return docs.mapInArrow(run, "doc_id long, whole long, mass double, keys array<long>, " + ", ".join(f"{c} long" for c in names))


def shared_room(texts: DataFrame, table, size: int) -> DataFrame:
    """``b, rooms`` of each of ``texts`` (doc_id, text): the weight of the shingles that another one has too, in CLASSES hash
    classes. A text's shingles are rows once, to find those that it has alone; its sums are one row. All aggregations combine
    before they shuffle, so a shingle of all texts is as cheap as any other."""
    rows, names = 1 << 18, [f"r{i}" for i in range(CLASSES)]

    def run(batches):
        cut, weight = Shingler(size), table.value
        held, n = [], 0

        def out():
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*held, strict=True)], ["shingle", "b", "weight"])

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), utf8(batch.column("text")), strict=True):
                shingles, times, _ = cut(text)
                held.append((shingles.view(np.int64), np.full(len(shingles), doc_id), weighed(shingles, times, weight)))
                n += len(shingles)
                if n >= rows:
                    yield out()
                    held, n = [], 0
        if held:
            yield out()

    def add(batches):
        cut, weight = Shingler(size), table.value
        for batch in batches:
            sums = np.zeros((CLASSES, batch.num_rows))
            for i, text in enumerate(utf8(batch.column("text"))):
                shingles, times, _ = cut(text)
                sums[:, i] = np.bincount(shingles.view(np.int64) % CLASSES, weighed(shingles, times, weight), CLASSES)
            made = pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, sums)], ["b", *names])
            yield made.filter(pa.array(sums.any(axis=0)))  # texts that have shingles

    texts = texts.select("doc_id", "text")
    every = texts.mapInArrow(run, "shingle long, b long, weight double")
    alone = every.groupBy("shingle").agg(F.count("*").alias("n"), F.min("b").alias("b"), F.min("weight").alias("weight")).where("n = 1")
    own = F.pmod("shingle", F.lit(CLASSES))
    less = alone.select("b", *[F.when(own == i, -F.col("weight")).otherwise(0.0).alias(r) for i, r in enumerate(names)])
    sums = texts.mapInArrow(add, "b long, " + ", ".join(f"{r} double" for r in names)).unionByName(less).groupBy("b").agg(*[F.sum(r).alias(r) for r in names])
    return sums.select("b", F.array(*names).alias("rooms"))


def verified(pairs: DataFrame, texts: DataFrame, table, size: int, threshold: float) -> DataFrame:
    """Of ``a, b`` (a written table) those pairs whose texts are similar enough, with ``similarity``. Rows come sorted by ``a``,
    whose text is cut into shingles once for all of its partners in a task."""
    leaders = pairs.groupBy("a").agg(F.count("*").alias("n"))
    blocks = block_counts(leaders, "a", pairs.count())
    own = pairs.hint("merge").join(texts.select(F.col("doc_id").alias("b"), "text"), "b")  # the plan doesn't turn with the size
    led = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("other")).join(leaders.select("a"), "a", "left_semi")
    both = block_join(own, led.hint("merge"), "a", "b", blocks)

    def run(batches):
        cut, weight = Shingler(size), table.value

        def read(text):
            shingles, times, _ = cut(text)
            return shingles, weighed(shingles, times, weight)

        last, left = None, None
        for batch in batches:
            out = []
            for a, x, y in zip(batch.column("a").to_pylist(), utf8(batch.column("other")), utf8(batch.column("text")), strict=True):
                if last != (a, x):
                    last, left = (a, x), read(x)
                out.append(weighted_jaccard(left, read(y)))
            made = pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(out, pa.float64())], ["a", "b", "similarity"])
            yield made.filter(pa.array([s >= threshold for s in out], pa.bool_()))

    return both.select("a", "b", "other", "text").mapInArrow(run, "a long, b long, similarity double")


def classes(links: DataFrame, rounds: int = 60) -> DataFrame:
    """``id, least`` of every id in ``links`` (a, b): the least id it is connected to. Each round gives every id the least
    label around it and then that label's own label, so chains shorten by half; each is written before the next one. A graph
    that needs more than ``rounds`` rounds (a chain of over 2**60 ids) raises an error."""
    edges = staged(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    degrees = edges.groupBy("b").agg(F.count("*").alias("n"))
    blocks = block_counts(degrees, "b", edges.count())
    labels = staged(edges.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("least")).withColumnRenamed("a", "id"), "labels")
    for _ in range(rounds):
        near = block_join(edges, labels.select(F.col("id").alias("b"), "least"), "b", "a", blocks).groupBy(F.col("a").alias("id")).agg(F.min("least").alias("near"))
        better = staged(labels.join(near, "id", "left").select("id", "least", F.least("least", "near").alias("new")), "better")
        # A label's own label: chains shorten by half. Many ids can have one label.
        jump = better.select(F.col("id").alias("new"), F.col("new").alias("jumped"))
        shared = block_counts(better.groupBy("new").agg(F.count("*").alias("n")), "new", better.count())
        after = staged(block_join(better, jump, "new", "id", shared).select("id", F.col("least").alias("was"), F.least("new", "jumped").alias("least")), "labels")
        moved = after.where("least <> was").limit(1).count()
        labels = after.select("id", "least")
        if not moved:
            return labels
    raise RuntimeError(f"classes still change after {rounds} rounds")


def near_duplicates(docs: DataFrame, threshold: float = 0.8, size: int = 5, bands: int = 12, rows: int = 3, cells: int = 1 << 19, rarest: int = 500) -> DataFrame:
    """``doc_id, class_id, n_verified`` of every row: the least doc_id of its class, and how many links of its text were verified (within a class not all need be)."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    table = spark.sparkContext.broadcast(idf(*document_frequencies(docs, size, cells), rarest))  # ``cells`` numbers
    codes = code_names(bands * rows)
    signed = staged(signatures(docs, table, size, bands, rows), "signatures")
    # Equal texts: the least document of each stands for all.
    least = F.min_by(F.struct("doc_id", "mass", "keys", *codes), "doc_id")
    whole = staged(signed.where("whole IS NOT NULL").groupBy("whole").agg(F.count("*").alias("n"), least.alias("_r")).where("_r.doc_id IS NOT NULL").select("whole", "n", "_r.*"), "wholes")
    keys = whole.select(F.col("doc_id").alias("b"), F.explode("keys").alias("key"))
    sizes = staged(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "sizes")
    total = bands * whole.count()
    hot = block_counts(sizes, "key", total)
    # How central a text is: the sizes of all its buckets together. What others were copied from is in the largest ones.
    buckets = block_join(keys, sizes, "key", "b", hot).groupBy("b").agg(F.sum("n").alias("central"), F.sort_array(F.collect_list("key")).alias("keys"))  # a text has one key a band
    members = staged(buckets.join(whole.select(F.col("doc_id").alias("b"), "mass", *codes), "b"), "members")
    # Only texts that share a bucket are ever compared: they are picked out once.
    texts = staged(docs.join(members.select(F.col("b").alias("doc_id")).hint("merge"), "doc_id", "left_semi"), "texts")
    alike = Alike(threshold, codes, differences_allowed(bands * rows, threshold))
    verify = lambda pairs: staged(verified(staged(pairs, "pairs"), texts, table, size, threshold), "links")
    links = verify(led_pairs(members, hot, alike))
    known = classes(links)
    links = staged(links.unionByName(verify(apart_pairs(members, known, sizes, total, alike, lambda ids: shared_room(texts.join(ids, "doc_id", "left_semi"), table, size)))), "links")
    links = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "similarity").dropDuplicates(["a", "b"])
    known = classes(links)
    # A document's class is its text's; what has no link is alone with its copies.
    ends = links.select(F.col("a").alias("doc_id")).unionByName(links.select(F.col("b").alias("doc_id"))).groupBy("doc_id").agg(F.count("*").alias("linked"))
    of_text = whole.select("whole", "doc_id").join(known.withColumnRenamed("id", "doc_id"), "doc_id", "left").join(ends, "doc_id", "left")
    of_text = of_text.select("whole", F.coalesce("least", "doc_id").alias("of_text"), "linked")
    copies = block_counts(whole.select("whole", "n"), "whole", total // bands)
    told = block_join(signed.where("whole IS NOT NULL").select("doc_id", "whole"), of_text, "whole", "doc_id", copies, "left").unionByName(
        signed.where("whole IS NULL").select("doc_id", "whole", F.lit(None).cast("long").alias("of_text"), F.lit(None).cast("long").alias("linked")))
    return told.select("doc_id", F.coalesce("of_text", "doc_id").alias("class_id"), F.coalesce("linked", F.lit(0)).cast("long").alias("n_verified"))


class Alike:
    """Whether two rows (``mass`` and codes, those of one with a prefix) can be a link, by what is known without their texts."""

    def __init__(self, threshold: float, codes: list[str], most: int):
        self.threshold, self.codes, self.most = threshold, codes, most

    def named(self, prefix: str) -> list[Column]:
        return [F.col(c).alias(prefix + c) for c in ("mass", *self.codes)]

    def differ(self, prefix: str) -> Column:
        return differences([F.col(c) for c in self.codes], [F.col(prefix + c) for c in self.codes])

    def possible(self, prefix: str) -> Column:
        a, b = F.col("mass"), F.col(prefix + "mass")
        return (F.least(a, b) >= (self.threshold - SLACK) * F.greatest(a, b)) & (self.differ(prefix) <= self.most)


def led_pairs(members: DataFrame, hot: DataFrame, alike: Alike) -> DataFrame:
    """``a, b``: every text with the one leader of its buckets that agrees with it best, if any can be a link."""
    flat = members.select("b", "central", "mass", *alike.codes, F.explode("keys").alias("key"))
    lead = flat.groupBy("key").agg(F.max_by(F.struct(F.col("b").alias("a"), *alike.named("a_")), F.struct("central", -F.col("b"))).alias("_l")).select("key", "_l.*")
    met = block_join(flat.drop("central"), lead, "key", "b", hot).where(F.col("a") != F.col("b")).where(alike.possible("a_"))
    return met.groupBy("b").agg(F.min_by("a", F.struct(alike.differ("a_"), F.col("a"))).alias("a")).select("a", "b")


def apart_pairs(members: DataFrame, known: DataFrame, sizes: DataFrame, total: int, alike: Alike, shared) -> DataFrame:
    """``a, b``: the pairs of texts that share a bucket, are in different classes of ``known`` and can be a link. ``shared`` gives
    the rooms (see ``shared_room``) of texts by id."""
    named = staged(members.join(known.withColumnRenamed("id", "b"), "b", "left").withColumn("own", F.coalesce("least", "b")).drop("least"), "named")
    flat = named.select("b", "central", "mass", *alike.codes, "own", "keys", F.explode("keys").alias("key"))
    mixed = flat.groupBy("key").agg(F.max_by("own", F.struct("central", -F.col("b"))).alias("main"), F.min("own").alias("low"), F.max("own").alias("high"), F.count("*").alias("n")).where("low < high").select("key", "main", "n")
    mixed = staged(mixed, "mixed")
    rest = staged(block_join(flat.drop("central"), mixed.drop("n"), "key", "b", block_counts(mixed, "key", total)), "rest")
    # All texts of these buckets are looked at together, so what one has alone can't be shared with another one there.
    left = F.aggregate("rooms", F.lit(0.0), lambda x, y: x + y)
    room = shared(rest.select(F.col("b").alias("doc_id")).distinct())
    near = staged(rest.join(room, "b").where(left >= (alike.threshold - SLACK) * F.col("mass")), "near")
    # One side of each pair is outside its bucket's main class; of two such texts the lesser one asks.
    ask = near.where("own <> main").select("key", F.col("b").alias("a"), F.col("own").alias("a_own"), F.col("rooms").alias("a_rooms"), F.col("keys").alias("a_keys"), *alike.named("a_"))
    asks = ask.groupBy("key").agg(F.count("*").alias("n"))
    met = block_join(ask, near, "key", "a", block_counts(asks, "key", total, per=256))
    both = F.aggregate(F.zip_with("rooms", "a_rooms", lambda x, y: F.least(x, y)), F.lit(0.0), lambda x, y: x + y)
    reach = both * (1 + alike.threshold) >= (alike.threshold - SLACK) * (F.col("mass") + F.col("a_mass"))
    once = F.array_intersect("a_keys", "keys")[0] == F.col("key")  # in the first bucket that both share
    met = met.where("own <> a_own AND (own = main OR a < b)").where(alike.possible("a_")).where(once).where(reach)
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the least of its class."""
    gone = unused(docs, "_gone")
    told = near_duplicates(docs, **options).where("doc_id <> class_id").select(F.col("doc_id").alias(gone)).distinct()
    return docs.join(told, F.col("doc_id").cast("long") == F.col(gone), "left_anti")
