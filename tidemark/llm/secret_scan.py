"""Secret scans with multipart credential linking, in DataFrame functions only.

Three kinds are found by patterns: assignments, access identifiers and long hex strings. They stand on their own. Weak
candidates do not: a long mixed string may be a secret, a URL may be an endpoint. Their parts are interval-joined with
identifiers inside a scope of ``SCOPE`` characters; a weak secret is reported where an identifier lies in its scope, a weak
endpoint where both an identifier and a secret do, a weak identifier, in a column of its own, where a secret of either strength
does.

Positions come from splitting a text at the matches of a pattern: the lengths of the gaps and of the matches add up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import empty_text, stage

# The base patterns and the least length of what they must match.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex")
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX = 6, 20, 24
# Longest matches of [0-9a-f]+ and AKIA[A-Z0-9]+ that are long enough; shorter ones are dropped anyway.
LONG_HEX = r"[0-9a-f]{24,}+"
LONG_ACCESS = r"AKIA[A-Z0-9]{16,}+"

# Weak candidates: a secret of 40 and more base64 characters, an endpoint, and identifiers besides access keys.
WEAK_SECRET = r"(?<![A-Za-z0-9+/=])[A-Za-z0-9+/]{40,}+={0,2}"
WEAK_ENDPOINT = r"https?://[A-Za-z0-9.-]++(?::[0-9]++)?(?:/[A-Za-z0-9._~/-]*+)?"
WEAK_ID = r"""(?i:client_id|access_key_id|account_id|user_name|username)["']?\x20*[:=]\x20*["']?([A-Za-z0-9._@-]{4,}+)"""
SCOPE = 400


def spans(text: Column, pattern: str, least: int = 0, group: int = 0) -> Column:
    """array<struct<start, stop>> of the matches of a pattern whose group has at least ``least`` characters.

    NULL when nothing matches, so that texts without a match cost one search.
    """
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    found = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.length)
    sizes = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.length) if group else found
    steps = F.zip_with(gaps, found, lambda gap, match: F.struct(gap.alias("gap"), match.alias("match")))
    steps = F.filter(F.zip_with(steps, sizes, lambda s, n: F.struct(s["gap"].alias("gap"), s["match"].alias("match"), n.alias("size"))),
                     lambda s: s["match"].isNotNull())
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int>>").alias("spans"))

    def step(acc: Column, s: Column) -> Column:
        begin = acc["at"] + s["gap"]
        own = F.array(F.struct(begin.alias("start"), (begin + s["match"]).alias("stop")))
        kept = F.when(s["size"] >= least, F.concat(acc["spans"], own)).otherwise(acc["spans"])
        return F.struct((begin + s["match"]).alias("at"), kept.alias("spans"))

    return F.when(text.rlike(pattern), F.aggregate(steps, start, step, lambda acc: acc["spans"]))


def _or_none(column: str) -> Column:
    return F.coalesce(F.col(column), F.array().cast("array<struct<start:int,stop:int>>"))


def _named(found: Column, kind: str, rank: int) -> Column:
    """Spans as sortable structs: by start, then the rank of the kind."""
    return F.transform(found, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), s["stop"].alias("stop")))


def _joined(found: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(found), lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def _linked(found: DataFrame) -> DataFrame:
    """doc_id, digest, added: weak candidates with their complementary parts in scope."""
    known = F.flatten(F.array(*[_or_none(k) for k in KINDS]))
    apart = lambda s: ~F.exists(known, lambda k: (k["start"] < s["stop"]) & (s["start"] < k["stop"]))
    parts = {
        "id": F.concat(_or_none("access"), _or_none("weak_id")),
        "weak_id": _or_none("weak_id"),
        "secret": F.filter(_or_none("weak_secret"), apart),
        "strong": F.concat(_or_none("assign"), _or_none("hex")),
        "endpoint": F.filter(_or_none("weak_endpoint"), apart),
    }
    weak = "weak_secret is not null or weak_endpoint is not null"
    some = found.where(f"(access is not null and ({weak})) or (weak_id is not null and ({weak} or assign is not null or hex is not null))")
    rows = some.select("doc_id", "digest", F.explode(F.concat(*[_named(s, k, 0) for k, s in parts.items()])).alias("s"))
    rows = stage(rows.select("doc_id", "digest", "s.*").distinct(), "parts")
    # A part meets those that begin in its own scope cell or a neighbouring one.
    cell = F.floor(F.col("start") / SCOPE)
    rows = rows.withColumn("cell", cell)
    spread = rows.withColumn("cell", F.explode(F.array(cell - 1, cell, cell + 1)))

    def near(left: DataFrame, right: DataFrame) -> DataFrame:
        x, y = left.alias("x"), right.alias("y")
        on = [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in ("doc_id", "digest")] + [F.col("x.cell") == F.col("y.cell")]
        return x.join(y, on + [F.abs(F.col("x.start") - F.col("y.start")) <= SCOPE], "left_semi")

    ids = spread.where("kind = 'id'")
    secrets = near(rows.where("kind = 'secret'"), ids)
    ends = near(near(rows.where("kind = 'endpoint'"), ids), spread.where("kind = 'secret' or kind = 'strong'"))
    named = near(rows.where("kind = 'weak_id'"), spread.where("kind = 'secret' or kind = 'strong'"))
    rank = F.when(F.col("kind") == "secret", 3).when(F.col("kind") == "endpoint", 4).otherwise(5)
    both = secrets.union(ends).union(named).drop("cell").withColumn("rank", rank)
    return both.groupBy("doc_id", "digest").agg(F.collect_set(F.struct("start", "rank", "kind", "stop")).alias("added"))


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_added, linked_ids for every row; a NULL text is empty.

    ``spans`` lists kind:start:end of base spans and of linked weak ones (kinds ``secret`` and ``endpoint``) by start, then
    kind; ``linked_ids`` lists the weak identifiers that have a secret in scope, as id:start:end. Repeated rows give the same result each. Other columns are ignored; an empty table gives no rows.
    """
    text = empty_text(text_col)
    # The text is read once; what is written is one narrow row a document.
    found = stage(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.xxhash64(text).alias("digest"),
            spans(text, ASSIGN, LEAST_VALUE, 2).alias("assign"),
            spans(text, LONG_ACCESS, LEAST_ACCESS).alias("access"),
            spans(text, LONG_HEX, LEAST_HEX).alias("hex"),
            spans(text, WEAK_ID).alias("weak_id"),
            spans(text, WEAK_SECRET).alias("weak_secret"),
            spans(text, WEAK_ENDPOINT).alias("weak_endpoint"),
        ),
        "secret-spans",
    )
    added = _linked(found).alias("a")
    f = found.alias("f")
    rows = f.join(
        added,
        F.col("f.doc_id").eqNullSafe(F.col("a.doc_id")) & F.col("f.digest").eqNullSafe(F.col("a.digest")),
        "left",
    )
    base = F.flatten(F.array(*[_named(_or_none(k), k, i) for i, k in enumerate(KINDS)]))
    linked = F.coalesce("added", F.array().cast("array<struct<start:int,rank:int,kind:string,stop:int>>"))
    more = F.filter(linked, lambda s: s["rank"] < 5)
    ids = F.transform(F.filter(linked, lambda s: s["rank"] == 5), lambda s: s.withField("kind", F.lit("id")))
    return rows.select(
        F.col("f.doc_id").alias("doc_id"),
        *[F.size(_or_none(k)).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"),
        _joined(F.concat(base, more)).alias("spans"),
        F.size(more).cast("long").alias("n_added"),
        _joined(ids).alias("linked_ids"),
    )
