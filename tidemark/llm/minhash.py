"""Near-duplicate documents: b-bit MinHash signatures joined by a multi-index Hamming join, links confirmed on full sets.

A signature has 60 positions of 12 bits: 12 chunks of 5 positions, one 64-bit integer each. Two signatures that differ
in at most 23 positions have, by the pigeonhole principle, a chunk that differs in at most one. Each chunk is therefore
looked up under its five ways to leave one position out (the allowed chunk errors), 60 keys a document, and every pair
within distance 23 meets under some key. Pairs at the similarity threshold of 0.75 differ in 15 positions on average
(standard deviation 3.4); the chance that such a pair shares no key is 0.367 ** 12, about 6e-6. Pairs that meet are
compared in full up to distance 33, more than five standard deviations above the mean.

No key's members are multiplied out. Equal sets are one class. In a first round the members of a key are compared with
the key's leader; in ``CHAINS`` further ones each with its neighbour in a random order of the key's members; each document
confirms its nearest such partner, and confirmed links make components. A text reaches the confirmation once for each pair
as the second document and once for up to ``LED`` pairs as the first. Documents whose keys then still hold several
components count their shingles in parts of the hash space, without those no other such document has. The common part of
a pair is at most the sum of the smaller counts, which bounds the sizes a partner can have; pairs of different components
within these bounds are enumerated, filtered by signature distance, and confirmed. Every pair under a common key is thus either confirmed, refuted or
already connected, so the components are those of all links.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tidemark.llm.components import joined_components
from tidemark.llm.shared import stage
from tidemark.llm.shingles import by_bytes, shingle_sets, text_slices

CHUNKS, WITHIN, BITS = 12, 5, 12
#: Pairs within 2 * CHUNKS - 1 positions are certain to meet; those that meet are kept up to this distance.
DISTANCE = 33
PERCENT = 75
CHAINS = 2
#: Members of a key that stand in one chain; larger keys have several, dealt anew in each round.
CHAIN_ROWS = 10_000
#: Pairs of one first document that are confirmed in one task.
LED = 1000
#: Ratio of the sizes that bound a slice of the last join, and rows of a slice that one task compares with others.
SLICE, SLICE_ROWS = 1.1, 500
#: Parts of the hash space in which shared shingles are counted apart.
PARTS = 32
PART = [f"c{i}" for i in range(PARTS)]
#: Bits of a bitmap of Spark, a fixed value.
MARKS = 1 << 15
SIGNATURE = [f"s{i}" for i in range(CHUNKS)]


def _multipliers() -> np.ndarray:
    return np.random.default_rng(20240229).integers(1, 1 << 63, CHUNKS * WITHIN, np.uint64) * np.uint64(2) + np.uint64(1)


def packed_signatures(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, CHUNKS) signed 64-bit integers, ``WITHIN`` codes of ``BITS`` bits in each; zeros for an empty set."""
    out = np.zeros((len(sets), CHUNKS), np.uint64)
    full = [i for i, s in enumerate(sets) if len(s)]
    if full:
        joined = np.concatenate([sets[i] for i in full])
        begins = np.concatenate([[0], np.cumsum([len(sets[i]) for i in full])[:-1]])
        for k, a in enumerate(_multipliers()):
            least = np.minimum.reduceat(((joined * a) >> np.uint64(32)).astype(np.uint32), begins)
            code = (least * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
            out[full, k // WITHIN] |= code.astype(np.uint64) << np.uint64(BITS * (k % WITHIN))
    return out.view(np.int64)


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """doc_id, row, n_shingles, two hashes of the set, the signature, the text, and ``keep`` columns as a struct.

    One row a document. ``row`` numbers the rows of the written table; it is not the same when the table is made again.
    """

    numbers = ["row", "n_shingles", "h1", "h2", *SIGNATURE]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for lo, hi, texts in text_slices(batch):
                sets = shingle_sets(texts)
                h1 = [int(np.bitwise_xor.reduce(s).view(np.int64)) if len(s) else 0 for s in sets]
                h2 = [int((s * s + (s >> np.uint64(7))).sum(dtype=np.uint64).view(np.int64)) for s in sets]
                columns = [np.arange(row, row + hi - lo), [len(s) for s in sets], h1, h2, *packed_signatures(sets).T]
                own = batch.slice(lo, hi - lo)
                arrays = [pa.array(c, pa.int64()) for c in columns]
                yield pa.RecordBatch.from_arrays([*own.columns, *arrays], [*own.schema.names, *numbers])
                row += hi - lo

    kept = F.struct(*keep) if keep else F.lit(None).cast("int")
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), kept.alias("kept"))
    return source.mapInArrow(run, StructType([*source.schema.fields, *[StructField(c, LongType()) for c in numbers]]))


def _keys() -> Column:
    """All keys of a signature: each chunk with one position left out, scrambled together with its slot."""
    every = (1 << 64) - 1
    out = []
    for c, name in enumerate(SIGNATURE):
        for o in range(WITHIN):
            mask = every ^ (((1 << BITS) - 1) << (BITS * o))
            mask = mask - (1 << 64) if mask >> 63 else mask
            out.append(F.xxhash64(F.lit(c * WITHIN + o), F.col(name).bitwiseAND(F.lit(mask))))
    return F.array(*out)


def _errors(a: str, b: str, name: str) -> Column:
    """Differing positions of one chunk: codes of the xor are folded to their lowest bit and counted."""
    lowest = sum(1 << (BITS * i) for i in range(WITHIN))
    x = F.col(f"{a}.{name}").bitwiseXOR(F.col(f"{b}.{name}"))
    for shift in (6, 3, 2, 1):
        x = x.bitwiseOR(F.shiftrightunsigned(x, shift).bitwiseAND(F.lit(_fold_mask(shift))))
    return F.bit_count(x.bitwiseAND(F.lit(lowest)))


def _distance(a: str, b: str) -> Column:
    """Differing positions of two signatures."""
    return sum((_errors(a, b, name) for name in SIGNATURE), F.lit(0))


def _first_meeting(a: str, b: str) -> Column:
    """Whether two signatures that share the key of slot ``a.slot`` share that of no smaller slot.

    Equal chunks meet under all their ``WITHIN`` slots, chunks with one error under one.
    """
    first = F.lit(True)
    for c, name in enumerate(SIGNATURE):
        later = F.col(f"{a}.slot") >= (c + 1) * WITHIN
        here = (F.col(f"{a}.slot") > c * WITHIN) & (F.col(f"{a}.slot") < (c + 1) * WITHIN)
        first = first & ~(later & (_errors(a, b, name) < 2))
        first = first & ~(here & (F.col(f"{a}.{name}") == F.col(f"{b}.{name}")))
    return first


def _fold_mask(shift: int) -> int:
    """Bits of each code that may receive a bit shifted down by ``shift`` without crossing from the next code."""
    one = (1 << (BITS - shift)) - 1
    return sum(one << (BITS * i) for i in range(WITHIN))


def _sizes_fit(x: str, y: str) -> Column:
    """Whether sets of these sizes can reach the threshold."""
    return 100 * F.least(x, y) >= PERCENT * F.greatest(x, y)


def _near(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """Pairs (a, b) whose signatures are near enough, with their distance."""
    joined = (
        pairs.alias("p")
        .join(reps.alias("x"), F.col("p.a") == F.col("x.rep"))
        .join(reps.alias("y"), F.col("p.b") == F.col("y.rep"))
    )
    near = joined.where(_sizes_fit("x.n_shingles", "y.n_shingles")).select("p.a", "p.b", _distance("x", "y").alias("distance"))
    return near.where(F.col("distance") <= DISTANCE)


def _nearest(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """For each b its nearest a."""
    return _near(pairs.distinct(), reps).groupBy("b").agg(F.min_by("a", F.struct("distance", "a")).alias("a"))


def _chain(placed: DataFrame, turn: int) -> DataFrame:
    """Neighbours of different components in a random order of each key's members."""
    part = F.pmod(F.xxhash64("rep", F.lit(turn)), F.ceil(F.col("members") / CHAIN_ROWS))
    order = f"over (partition by key, part order by xxhash64(rep, {-turn}), rep)"
    rows = placed.withColumn("part", part)
    for c in ("rep", "component", "n"):
        rows = rows.withColumn(f"last_{c}", F.expr(f"lag({c}) {order}"))
    rows = rows.where((F.col("component") != F.col("last_component")) & _sizes_fit("n", "last_n"))
    return rows.select(F.col("last_rep").alias("a"), F.col("rep").alias("b"))


def _marked(df: DataFrame, rows: DataFrame, column: str = "row") -> tuple[DataFrame, Column]:
    """``df`` past the written bitmaps of ``rows``, and whether its row is among them. Exact.

    A bitmap holds ``MARKS`` neighbouring row numbers, so the table is a bit a document and ``df``, with its texts, is read
    past it where it lies, also where ``rows`` themselves are too many for that.
    """
    bits = rows.select(F.expr(f"{column} div {MARKS} as _marks"), (F.col(column) % MARKS).alias("place"))
    # All rows of a bitmap are brought together first, not a bitmap from each task.
    bits = bits.repartition("_marks").groupBy("_marks").agg(F.bitmap_construct_agg("place").alias("_bits"))
    joined = df.withColumn("_marks", F.expr(f"row div {MARKS}")).join(stage(bits, "marks"), "_marks", "left")
    byte = F.conv(F.hex(F.expr(f"substring(_bits, cast(row % {MARKS} as int) div 8 + 1, 1)")), 16, 10).cast("int")
    held = byte.bitwiseAND(F.expr("shiftleft(1, cast(row % 8 as int))")) != 0
    return joined, F.coalesce(held, F.lit(False))


def _confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs whose full shingle sets reach the threshold, written.

    The pairs of one first document stand behind its text, in parts of about ``LED`` pairs, and are read as a stream: a task
    holds the set of one first document and those of a few texts.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        leader, held = None, None
        for batch in batches:
            texts = batch["text"].tolist()
            for lo, hi in by_bytes(texts):
                keep = []
                rows = zip(batch["a"].iloc[lo:hi], batch["b"].iloc[lo:hi], shingle_sets(texts[lo:hi]))
                for a, b, own in rows:
                    if a == b:
                        leader, held = a, own
                        continue
                    if a != leader:
                        raise ValueError("a pair without the text of its first document")
                    same = np.intersect1d(held, own, assume_unique=True).size
                    if 100 * same >= PERCENT * (len(held) + len(own) - same):
                        keep.append((a, b))
                yield pd.DataFrame(keep, columns=["a", "b"], dtype=np.int64)

    pairs = stage(pairs, "pairs")
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / F.lit(LED)).alias("parts"))
    dealt = pairs.join(parts, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).alias("part"))
    dealt = stage(dealt, "dealt")
    wanted = dealt.union(dealt.select("a", F.col("a").alias("b"), "part").distinct())
    # Only texts of pairs are shuffled; all others stay where they were read.
    marked, held = _marked(texts, wanted, "b")
    used = marked.where(held).select(F.col("row").alias("b"), "text")
    ready = wanted.join(used, "b").select("a", "part", "b", "text")
    first = F.col("a") != F.col("b")
    return ready.repartition("a", "part").sortWithinPartitions("a", "part", first).select("a", "b", "text").mapInPandas(run, "a long, b long").transform(stage, "links")


def _by_hash(s: np.ndarray) -> np.ndarray:
    """How many shingles of a set fall into each of ``PARTS`` parts of the hash space."""
    return np.bincount((s % np.uint64(PARTS)).astype(np.int64), minlength=PARTS)


def _shared(still: DataFrame, texts: DataFrame) -> DataFrame:
    """``still`` with ``shared``, how many of a document's shingles some other open document has, and that by part."""

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["text"].tolist()
            for lo, hi in by_bytes(texts):
                sets = shingle_sets(texts[lo:hi])
                docs = np.repeat(batch["row"].to_numpy()[lo:hi], [len(s) for s in sets])
                yield pd.DataFrame({"rep": docs, "shingle": np.concatenate(sets).view(np.int64)})

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["text"].tolist()
            for lo, hi in by_bytes(texts):
                own = [np.array([] if o is None else o, np.int64).view(np.uint64) for o in batch["own"].iloc[lo:hi]]
                parts = np.array([_by_hash(s) - _by_hash(o) for s, o in zip(shingle_sets(texts[lo:hi]), own)])
                yield pd.DataFrame({"rep": batch["row"].iloc[lo:hi].to_numpy()} | {c: parts[:, i] for i, c in enumerate(PART)})

    marked, held = _marked(texts, still, "rep")
    opened = stage(marked.where(held).select("row", "text"), "opened")
    shingles = opened.mapInPandas(split, "rep long, shingle long").groupBy("shingle")
    alone = shingles.agg(F.count("*").alias("docs"), F.min("rep").alias("row")).where("docs = 1")
    own = alone.groupBy("row").agg(F.collect_list("shingle").alias("own"))
    parts = opened.join(own, "row", "left").select("row", "text", "own")
    parts = parts.mapInPandas(count, "rep long, " + ", ".join(f"{c} int" for c in PART))
    return still.join(parts, "rep").withColumn("shared", sum((F.col(c) for c in PART), F.lit(0)))


def _across(still: DataFrame, reps: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs of different components under a common key that can reach the threshold by their sizes and shared shingles.

    With I common shingles of sets of x and y, the threshold is (100 + P) * I >= P * (x + y), and I is at most the sum
    over the parts of the smaller of both shared counts. The smaller set of a pair must pass with a partner of its own
    size; the larger one has a largest partner, ``top``, and a smallest, ``low``. A pair that meets under several keys
    is made under the first of them only. The smaller sets of a large slice of a key are dealt to blocks, and each larger
    set meets every block, so the comparisons of a hot key are those of many tasks.
    """
    shared = _shared(still, texts)
    rows = stage(shared.join(reps.select("rep", F.col("n_shingles").alias("n"), *SIGNATURE), ["rep", "n"]), "shared")
    # None of these is NULL; said so, the condition of the join compiles to code short enough for the JIT.
    known = [*PART, *SIGNATURE, "shared", "component", "n", "rep", "slot"]
    rows = rows.withColumns({c: F.coalesce(c, F.lit(0)) for c in known})
    whole = 100 + PERCENT
    size = lambda n: F.floor(F.log(n) / float(np.log(SLICE)))
    small = rows.where(whole * F.col("shared") >= 2 * PERCENT * F.col("n")).withColumn("slice", size(F.col("n")))
    blocks = small.groupBy("key", "slice").agg(F.ceil(F.count("*") / F.lit(SLICE_ROWS)).cast("int").alias("blocks"))
    blocks = stage(blocks, "slices")
    held = small.groupBy("key").agg(
        F.min("component").alias("lo"), F.max("component").alias("hi"), F.min("n").alias("least"), F.max("n").alias("most")
    )
    low = F.ceil(F.col("n") * PERCENT / 100)
    top = F.least("n", F.floor(whole * F.col("shared") / PERCENT).cast("long") - F.col("n"))
    large = rows.join(held, "key").where("lo <> component or hi <> component")
    large = large.withColumn("low", F.greatest(low, "least")).withColumn("top", F.least(top, "most")).where("low <= top")
    large = large.withColumn("slice", F.explode(F.sequence(size(F.col("low")), size(F.col("top")))))
    small = small.join(blocks, ["key", "slice"]).withColumn("block", F.pmod(F.xxhash64("rep"), "blocks").cast("int"))
    large = large.join(blocks, ["key", "slice"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    x, y = small.alias("x"), large.alias("y")
    both = F.col("x.n") + F.col("y.n")
    common = F.expr(" + ".join(f"if(x.{c} < y.{c}, x.{c}, y.{c})" for c in PART))
    fits = (whole * F.least("x.shared", "y.shared") >= PERCENT * both) & (whole * common >= PERCENT * both)
    ordered = F.struct("x.n", "x.rep") < F.struct("y.n", "y.rep")
    apart = F.col("x.component") != F.col("y.component")
    met = (F.col("x.key") == F.col("y.key")) & (F.col("x.slice") == F.col("y.slice")) & (F.col("x.block") == F.col("y.block"))
    pairs = x.join(y, met & apart & ordered & _first_meeting("x", "y") & fits)
    return pairs.select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b")).distinct()


def _grouped(sig: DataFrame) -> DataFrame:
    """doc_id, row, n_shingles and component_id of every row of a written table of signatures."""
    same, texts = ["n_shingles", "h1", "h2"], sig.select("row", "text")
    full = sig.where("n_shingles > 0 and doc_id is not null").drop("text", "kept")
    # A class is known by one of its rows: every class has one text, also where an id has several.
    classes = full.groupBy(*same).agg(
        F.min("row").alias("rep"), F.min("doc_id").alias("smallest"), *[F.min(c).alias(c) for c in SIGNATURE]
    )
    reps = stage(classes, "classes")

    keyed = reps.select("rep", F.col("n_shingles").alias("n"), F.posexplode(_keys()).alias("slot", "key"))
    groups = keyed.groupBy("key").agg(F.count("*").alias("members"), F.min("rep").alias("leader")).where("members > 1")
    keyed = stage(keyed.join(groups, "key"), "keys")

    def placed(comp: DataFrame) -> DataFrame:
        """Members of keys that still lie in several components."""
        rows = keyed.join(comp, keyed["rep"] == comp["node"], "left").select(
            "key", "slot", "rep", "n", "members", F.coalesce("component", "rep").alias("component")
        )
        several = rows.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi")
        return stage(rows.join(several.select("key"), "key", "left_semi"), "open")

    led = keyed.where("rep <> leader").select(F.col("leader").alias("a"), F.col("rep").alias("b"))
    comp = joined_components(None, _confirmed(_nearest(led, reps), texts), "a", "b")
    still = placed(comp)
    for turn in range(1, CHAINS + 1):
        comp = joined_components(comp, _confirmed(_nearest(_chain(still, turn), reps), texts), "a", "b")
        still = placed(comp)
    across = _across(still, reps, texts)
    comp = joined_components(comp, _confirmed(_near(across, reps).select("a", "b"), texts), "a", "b")

    # Classes that hold rows of one id are of one component too.
    named = full.select("doc_id", *same).distinct().join(reps.select("rep", *same), same).select("doc_id", "rep")
    lowest = named.groupBy("doc_id").agg(F.min("rep").alias("low"), F.count("*").alias("n")).where("n > 1")
    repeated = named.join(lowest, "doc_id").where("rep <> low").select(F.col("low").alias("a"), F.col("rep").alias("b"))
    found = joined_components(comp, repeated, "a", "b")
    ended = reps.join(found, reps["rep"] == found["node"], "left")
    ended = stage(ended.select(*same, "smallest", F.coalesce("component", "rep").alias("component")), "ended")
    least = ended.groupBy("component").agg(F.min("smallest").alias("component_id"))
    of = ended.join(least, "component").select(*same, "component_id")
    known = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    rows = sig.select("doc_id", "row", *same).join(of, same, "left")
    return rows.select("doc_id", "row", "n_shingles", known.alias("component_id"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs``.

    Documents are linked when 100 * |A and B| >= 75 * |A or B| for their sets of 5-word shingles. A NULL or wordless
    text has an empty set and links with nothing; a row with a NULL id links with nothing, has a NULL component and is
    kept. Rows that repeat an id with another text that has words are of one component by that id. Other columns are
    ignored. An empty table gives no rows.
    """
    sig = stage(signatures(docs, id_col, text_col), "signatures")
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    return _grouped(sig).select("doc_id", "n_shingles", "component_id", kept.alias("kept"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without near copies: one row of each component, of its smallest id.

    Of rows that repeat that id one stays. Rows with a NULL id all stay. The columns are those of ``docs``, unchanged; a
    text is read from the written table past a bit a row, and not shuffled.
    """
    others = [c for c in docs.columns if c != text_col]
    sig = stage(signatures(docs, id_col, text_col, others), "signatures")
    rows = stage(_grouped(sig).where("doc_id is not null"), "components")
    stays = rows.where("doc_id = component_id").groupBy("component_id").agg(F.min("row").alias("stay"))
    gone = rows.join(stays, "component_id", "left").where("stay is null or row <> stay").select("row")
    columns = [F.col("text").alias(c) if c == text_col else F.col(f"kept.`{c}`") for c in docs.columns]
    marked, held = _marked(sig, gone)
    return marked.where(~held).select(*columns)
