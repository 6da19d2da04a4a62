"""Time travel over revisions (TT, JN, AG1, PRJ2-3, FLT15-16 of the survey).

A revision table has ``page_id, revision_id, ts`` and whatever else; revisions of
a page are ordered by (ts, revision_id), however the dump had them. ``key`` names
the columns of a page where several wikis share a table.

Rows with the key, time and id of another are repeats of one revision. In sequences a revision counts once: the
row whose other columns have the smallest hash stays, as in imports.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.operators.numbering import numbered
from palimpsest.schemas import KEY_FRAME_INTERVAL, SENTINEL_LAYER
from palimpsest.storage import materialise

ORDER = ("ts", "revision_id")
PAGE_KEY = ("page_id",)
#: Revisions of one page up to which its sequence is made by a window, in one task; beyond, rows are numbered by ranges.
WINDOW_ROWS = 200_000


def instant(revisions: DataFrame, at: str | datetime | Column) -> Column:
    """``at`` in the type of the table's timestamps."""
    return (at if isinstance(at, Column) else F.lit(at)).cast(revisions.schema["ts"].dataType)


def chronology(key=PAGE_KEY) -> W:
    return W.partitionBy(*key).orderBy(*ORDER)


def _picked(revisions: DataFrame, pick, key) -> DataFrame:
    """One whole revision for each page, by an aggregate that combines on the map side."""
    rest = [c for c in revisions.columns if c not in key]
    return revisions.groupBy(*key).agg(pick(F.struct(*rest), F.struct(*ORDER)).alias("_r")).select(*key, "_r.*").select(revisions.columns)


def revision_at(revisions: DataFrame, at, key=PAGE_KEY) -> DataFrame:
    """TT1/JN9: of each page the last revision not after ``at``; pages that begin later are absent."""
    return _picked(revisions.where(F.col("ts") <= instant(revisions, at)), F.max_by, key)


def revision_as_of(requests: DataFrame, revisions: DataFrame, key=PAGE_KEY, at: str = "at", columns=("ts", "revision_id")) -> DataFrame:
    """JN9 for a table of requests (``key``, ``at`` and whatever else): each with ``columns`` of its page's last revision not after ``at``.

    All requests stay, repeated ones too; where the page is unknown or begins later, or ``at`` is null, the columns are null.
    Revisions without a time are never found. The columns must not have names that the requests have.

    Requests and revisions are put in one order of (key, time), cut into ranges of like size wherever these fall, also
    within a page or an instant. Within a range the last revision is a running maximum; what a range inherits
    is the last revision of those before it, of which there is one a range. So a page that has most of the
    rows is many tasks. Other columns than time and id are fetched by an equi-join with the revisions found.
    """
    clash = set(columns) & set(requests.columns)
    if clash:
        raise ValueError(f"requests have columns named like the revisions': {sorted(clash)}")
    kind = revisions.schema["ts"].dataType
    page = F.struct(*[F.col(c).alias(c) for c in key])
    asked = materialise(requests.select(F.struct(*[F.col(f"`{c}`").alias(c) for c in requests.columns]).alias("_q"), page.alias("_page"), F.col(at).cast(kind).alias("_t"), F.monotonically_increasing_id().alias("_id")), "requests")
    known = revisions.where(F.col("ts").isNotNull()).select(page.alias("_page"), F.col("ts").alias("_t"), F.col("revision_id").alias("_r")).distinct()
    # At one instant, revisions come first; the number of a request keeps equal ones apart, so they may fall into several ranges.
    rows = asked.withColumn("_r", F.lit(None).cast(known.schema["_r"].dataType)).unionByName(known, allowMissingColumns=True).withColumn("_asks", F.col("_id").isNotNull())
    order = ["_page", "_t", "_asks", "_r", "_id"]
    ranged = materialise(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "as-of")
    here = F.when(~F.col("_asks"), F.struct("_page", "_t", "_r"))
    local = F.max(here).over(W.partitionBy("_part").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow))
    tails = ranged.groupBy("_part").agg(F.max(here).alias("_tail"))  # one row a range
    inherited = tails.select("_part", F.max("_tail").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)).alias("_inherited"))
    last = ranged.withColumn("_last", local).where("_asks").join(F.broadcast(inherited), "_part", "left").withColumn("_last", F.coalesce("_last", "_inherited"))
    found = last.select("_q", F.when(F.col("_last._page").eqNullSafe(F.col("_page")) & F.col("_t").isNotNull(), F.col("_last")).alias("_last"))
    own = {"ts": F.col("_last._t"), "revision_id": F.col("_last._r")}
    rest = [c for c in columns if c not in own]
    if rest:
        wide = distinct_revisions(revisions, key).select(page.alias("_page"), "_at", F.struct(*rest).alias("_w"))
        found = found.select("_q", "_last", F.col("_last._page").alias("_page"), F.struct(F.col("_last._t").alias("ts"), F.col("_last._r").alias("revision_id")).alias("_at")).join(wide, ["_page", "_at"], "left")
        own |= {c: F.col(f"_w.`{c}`") for c in rest}
    return found.select(*[F.col(f"_q.`{c}`").alias(c) for c in requests.columns], *[own[c].alias(c) for c in columns])


def first_revision(revisions: DataFrame, key=PAGE_KEY) -> DataFrame:
    """TT2."""
    return _picked(revisions, F.min_by, key)


def latest_revision(revisions: DataFrame, key=PAGE_KEY) -> DataFrame:
    """TT3, FLT15."""
    return _picked(revisions, F.max_by, key)


def crowded(revisions: DataFrame, key=PAGE_KEY, limit: int | None = None) -> bool:
    """Whether a page has more revisions than one task should sort; one count, combined on the map side."""
    most = revisions.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    return most > (WINDOW_ROWS if limit is None else limit)


def at_of() -> Column:
    """Time and id as one value, which tells a page's revisions apart, those without a time included."""
    return F.struct(*ORDER)


def content_hash(revisions: DataFrame, key=PAGE_KEY) -> Column:
    """A hash of the other columns, as far as they are of plain types; settles which repeat stays."""
    rest = [f"`{f.name}`" for f in revisions.schema if f.name not in (*key, *ORDER) and isinstance(f.dataType, T.AtomicType)]
    return F.xxhash64(*rest) if rest else F.lit(0).cast("long")


def distinct_revisions(revisions: DataFrame, key=PAGE_KEY) -> DataFrame:
    """Each revision once, with ``_at``; rows are spread by revision, so no page meets in one task."""
    same = W.partitionBy(*key, "_at").orderBy("_hash")
    marked = revisions.withColumn("_at", at_of()).withColumn("_hash", content_hash(revisions, key)).withColumn("_k", F.row_number().over(same))
    return marked.where("_k = 1").drop("_k", "_hash")


def _by_page(revisions: DataFrame, key) -> DataFrame:
    """Each revision once, in the order of its page; further windows over ``chronology`` need no shuffle or sort."""
    order = W.partitionBy(*key).orderBy(*ORDER, "_hash")
    marked = revisions.withColumn("_hash", content_hash(revisions, key)).withColumn("_before", F.lag(at_of()).over(order))
    return marked.where(~F.col("_before").eqNullSafe(at_of())).drop("_before", "_hash")


def sequenced(revisions: DataFrame, key=PAGE_KEY, carry=()) -> DataFrame:
    """``key, ts, revision_id`` and the columns ``carry`` of every revision, with ``rn``, ``cnt`` and ``previous`` and ``following``: those columns of its neighbours.

    Every revision comes once. No page is sorted in one task: rows are numbered by ranges of (key, ts, revision_id), a page's first number and its
    count are aggregates, and neighbours are an equi-join on the number.
    """
    names = [*ORDER, *carry]
    once = revisions.groupBy(*key, *ORDER).agg(*[F.min_by(c, content_hash(revisions, key)).alias(c) for c in carry]) if carry else revisions.select(*key, *ORDER).distinct()
    rows = numbered(once, [*key, *ORDER], "_number")
    bounds = rows.groupBy(*key).agg(F.min("_number").alias("_first"), F.count(F.lit(1)).alias("cnt"))
    placed = rows.join(bounds, list(key)).withColumn("rn", F.col("_number") - F.col("_first") + 1)
    beside = placed.select(F.col("_number").alias("_n"), "rn", "cnt", F.struct(*names).alias("_beside"))
    before = beside.where("rn < cnt").select((F.col("_n") + 1).alias("_number"), F.col("_beside").alias("previous"))
    after = beside.where("rn > 1").select((F.col("_n") - 1).alias("_number"), F.col("_beside").alias("following"))
    return placed.join(before, "_number", "left").join(after, "_number", "left").drop("_number", "_first")


def _with_sequence(revisions: DataFrame, key, **columns: Column) -> DataFrame:
    """``revisions``, each once, with columns of ``sequenced``, joined back by key and revision."""
    found = sequenced(revisions, key).select(*key, at_of().alias("_at"), *[value.alias(name) for name, value in columns.items()])
    joined = distinct_revisions(revisions.drop(*columns), key).join(found, [*key, "_at"])
    return joined.select(*[c for c in revisions.columns if c not in columns], *columns)


def positions(revisions: DataFrame, key=PAGE_KEY) -> DataFrame:
    """TT4: ``rn`` (from 1) and ``cnt`` of every revision within its page."""
    if crowded(revisions, key):
        return _with_sequence(revisions, key, rn=F.col("rn"), cnt=F.col("cnt"))
    return _by_page(revisions, key).withColumn("rn", F.row_number().over(chronology(key)).cast("long")).withColumn("cnt", F.count(F.lit(1)).over(W.partitionBy(*key)))


def sequence_from(revisions: DataFrame, starts: DataFrame, key=PAGE_KEY) -> DataFrame:
    """TT6: the revisions of each page from the one that ``starts`` names (key and ``revision_id``) onwards, with ``rn``.

    A page may have several starts, and then comes with each. Starts that are no revisions of their page give nothing.
    """
    placed = positions(revisions, key)
    own = placed.select(*key, "revision_id", F.col("rn").alias("_from")).join(starts.select(*key, "revision_id").distinct(), [*key, "revision_id"], "left_semi").drop("revision_id")
    kept = placed.drop("cnt").join(own, list(key)).where(F.col("rn") >= F.col("_from"))
    return kept.withColumn("rn", F.col("rn") - F.col("_from") + 1).drop("_from").select(*revisions.columns, "rn")


def neighbours(revisions: DataFrame, key=PAGE_KEY) -> DataFrame:
    """TT7: ``previous_id`` and ``next_id`` of every revision."""
    if crowded(revisions, key):
        return _with_sequence(revisions, key, previous_id=F.col("previous.revision_id"), next_id=F.col("following.revision_id"))
    return _by_page(revisions, key).withColumn("previous_id", F.lag("revision_id").over(chronology(key))).withColumn("next_id", F.lead("revision_id").over(chronology(key)))


def intervals(revisions: DataFrame, key=PAGE_KEY) -> DataFrame:
    """TT8: each revision is valid in [``valid_from``, ``valid_to``); the last one until the sentinel."""
    end = instant(revisions, SENTINEL_LAYER)
    if crowded(revisions, key):
        return _with_sequence(revisions, key, valid_from=F.col("ts"), valid_to=F.coalesce("following.ts", end))
    until = F.coalesce(F.lead("ts").over(chronology(key)), end)
    return _by_page(revisions, key).withColumn("valid_from", F.col("ts")).withColumn("valid_to", until)


def snapshots(revisions: DataFrame, instants: DataFrame, key=PAGE_KEY) -> DataFrame:
    """TT12 for many instants (column ``at``): every page's revision at each, one scan and one shuffle of the revisions.

    The instants, sorted, are an array in every task (more than ``MAX_INSTANTS`` are an error). A revision counts for the first
    instant that isn't before it: of each page and such instant only the last revision is shuffled, combined on the
    map side, and then carried on to the instants behind, of which a page has as many as were asked for.
    """
    kind = revisions.schema["ts"].dataType
    times = sorted(r["at"] for r in instants.select(F.col("at").cast(kind).alias("at")).distinct().limit(MAX_INSTANTS + 1).collect() if r["at"] is not None)
    if len(times) > MAX_INSTANTS:
        raise ValueError(f"more than {MAX_INSTANTS} instants at once")
    array = F.array(*[F.lit(t).cast(kind) for t in times]) if times else F.array().cast(f"array<{kind.simpleString()}>")
    slot = F.size(F.filter(array, lambda t: t < F.col("ts")))
    rest = [c for c in revisions.columns if c not in key]
    rows = revisions.withColumn("_slot", slot).where(F.col("_slot") < len(times))
    last = rows.groupBy(*key, "_slot").agg(F.max_by(F.struct(*rest), F.struct(*ORDER)).alias("_r"))
    until = F.coalesce(F.lead("_slot").over(W.partitionBy(*key).orderBy("_slot")), F.lit(len(times)))
    held = last.withColumn("_until", until).select(*key, "_r", F.explode(F.sequence(F.col("_slot"), F.col("_until") - 1)).alias("_slot"))
    return held.select(*key, "_r.*", F.element_at(array, F.col("_slot") + 1).alias("at")).select(*revisions.columns, "at")


MAX_INSTANTS = 1000


def key_frames(revisions: DataFrame, interval: int = KEY_FRAME_INTERVAL, key=PAGE_KEY) -> DataFrame:
    """TT14: ``rn`` and ``is_key``: the first of every ``interval`` revisions of a page, and its last."""
    rows = positions(revisions, key)
    return rows.withColumn("is_key", ((F.col("rn") - 1) % interval == 0) | (F.col("rn") == F.col("cnt"))).drop("cnt")


def revision_counts(revisions: DataFrame, key=PAGE_KEY) -> DataFrame:
    """AG1."""
    return revisions.groupBy(*key).agg(F.count(F.lit(1)).alias("n_revisions"))


def with_parent(revisions: DataFrame, key=()) -> DataFrame:
    """JN5: ``parent_ts`` of each revision's parent; null where it has none or it is unknown."""
    parents = revisions.select(*key, F.col("revision_id").alias("parent_id"), F.col("ts").alias("parent_ts"))
    return revisions.join(parents, [*key, "parent_id"], "left")


def with_author(revisions: DataFrame, contributors: DataFrame, key=()) -> DataFrame:
    """PRJ2/JN3: ``author`` is the ip if there is one, else the contributor's name, else null."""
    names = contributors.select(*key, "contributor_id", F.col("name").alias("_name"))
    return revisions.join(names, [*key, "contributor_id"], "left").withColumn("author", F.coalesce("ip", "_name")).drop("_name")


def byte_length(stored: Column, text: Column) -> Column:
    """PRJ3: the stored size, else the UTF-8 length of the text."""
    return F.coalesce(stored, F.octet_length(text))


def with_page(rows: DataFrame, pages: DataFrame, key=PAGE_KEY) -> DataFrame:
    """JN1/JN2: revisions or tiers beside their pages' columns."""
    return rows.join(pages, list(key))


def by_contributor(revisions: DataFrame, contributors: DataFrame, key=()) -> DataFrame:
    """JN4: contributors beside their revisions."""
    return contributors.join(revisions, [*key, "contributor_id"])


def tiers_at(tiers: DataFrame, wanted: DataFrame, key=PAGE_KEY) -> DataFrame:
    """JN10: tiers at exactly the wanted instants (key and ``ts``)."""
    return tiers.join(wanted.select(*key, "ts").distinct(), [*key, "ts"], "left_semi")


def new_tiers(tiers: DataFrame, pages: DataFrame, at, key=PAGE_KEY) -> DataFrame:
    """TT9: (key, ``ts``) of the pages that have no tier at ``at`` yet."""
    wanted = pages.select(*key, instant(tiers, at).alias("ts")).distinct()
    return wanted.join(tiers.select(*key, "ts"), [*key, "ts"], "left_anti")


def unrendered(rows: DataFrame) -> DataFrame:
    """FLT16."""
    return rows.where(F.col("html").isNull())
