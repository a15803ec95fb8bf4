"""Incremental loads: what changed, what pairs up, and how rows are brought up to date."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions import scalars as S
from tessella.sources.shared import stored

#: Columns that a new reading of a file resets.
DERIVED = ("embed", "category", "category_score", "category_guess", "category_guess_score", "cluster", "cluster_score", "focus", "shot_size", "problem")


def pair_raw(files: DataFrame) -> DataFrame:
    """files (rel, is_raw, is_video) with `sibling`: each RAW with its standard file, and such RAWs left out.

    Three scopes, each for what is left: the same folder and stem (first of each); the folder's parent and the stem; the
    whole tree and the stem; in the last two only where it is unique on both sides. Videos never pair.
    """
    rows = files.withColumns({"_stem": F.lower(S.stem(F.col("rel"))), "_dir": S.parent(F.col("rel"))})
    rows = stored(rows.withColumn("_up", S.parent(F.col("_dir"))), "files")
    left, done = rows.filter(~F.col("is_video")).select("rel", "is_raw", "_stem", "_dir", "_up"), []
    raw, std = F.col("is_raw"), ~F.col("is_raw")
    for scope in (["_dir", "_stem"], ["_up", "_stem"], ["_stem"]):
        of = lambda kind: F.min(F.when(kind, F.col("rel")))
        sets = left.dropna(subset=scope).groupBy(*scope).agg(of(std).alias("_std"), of(raw).alias("_raw"), F.count_if(std).alias("_n_std"), F.count_if(raw).alias("_n_raw"))
        paired = (F.col("_n_std") > 0) & (F.col("_n_raw") > 0) if scope[0] == "_dir" else (F.col("_n_std") == 1) & (F.col("_n_raw") == 1)
        pairs = stored(sets.filter(paired).select(*scope, "_std", "_raw"), "pairs")
        done.append(pairs.select(F.col("_std").alias("rel"), F.col("_raw").alias("sibling")))
        if scope != ["_stem"]:
            gone = F.coalesce(F.col("rel") == F.when(raw, F.col("_raw")).otherwise(F.col("_std")), F.lit(False))
            left = stored(left.join(pairs, scope, "left").filter(~gone).select("rel", "is_raw", "_stem", "_dir", "_up"), "files-left")
    done = reduce(DataFrame.unionByName, done)
    marks = done.withColumn("_gone", F.lit(False)).unionByName(done.select(F.col("sibling").alias("rel"), F.lit(None).cast("string").alias("sibling"), F.lit(True).alias("_gone")))
    marks = marks.groupBy("rel").agg(F.max("sibling").alias("sibling"), F.bool_or("_gone").alias("_gone"))
    return rows.drop("_stem", "_dir", "_up").join(marks, "rel", "left").filter(~F.coalesce("_gone", F.lit(False))).drop("_gone")


def detect_changes(listing: DataFrame, known: DataFrame, retry_errors: bool = False) -> DataFrame:
    """(rel, action) of a listing (rel, size, mtime) against known rows with a status: new, changed, restore, missing,
    deleted, keep. One full outer join."""
    a = listing.select("rel", F.col("size").alias("_size"), F.col("mtime").alias("_mtime"), F.lit(True).alias("_here"))
    b = known.select("rel", "size", "mtime", "status", F.lit(True).alias("_known"))
    same = F.col("_size").eqNullSafe(F.col("size")) & F.col("_mtime").eqNullSafe(F.col("mtime"))
    here, was = F.col("_here").isNotNull(), F.col("_known").isNotNull()
    action = (
        F.when(here & ~was, "new").when(~here & (F.col("status") == "pending"), "deleted").when(~here & (F.col("status") == "missing"), "keep")
        .when(~here, "missing").when((F.col("status") == "missing") & same, "restore").when(F.col("status").isin("missing", "pending"), "changed")
        .when(~same, "changed").when(F.lit(retry_errors) & (F.col("status") == "error"), "changed").otherwise("keep")
    )
    return a.join(b, "rel", "full_outer").select("rel", action.alias("action"))


def upsert(target: DataFrame, updates: DataFrame, key: str = "rel") -> DataFrame:
    """target with the updates' rows in place of those with the same key; derived columns of these are reset, others that
    the updates lack are kept. The result is a new table: it is never written over the one that is read."""
    old = target.alias("o")
    new = updates.alias("n")
    joined = old.join(new, key, "full_outer")
    hit = F.col("_hit").isNotNull()
    joined = old.join(new.withColumn("_hit", F.lit(True)), key, "full_outer")
    columns = []
    for c in target.columns:
        if c == key:
            columns.append(F.col(key))
        elif c in updates.columns:
            columns.append(F.when(hit, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c))
        elif c in DERIVED:
            columns.append(F.when(~hit, F.col(f"o.{c}")).alias(c))
        else:
            columns.append(F.col(f"o.{c}").alias(c))
    return joined.select(*columns)


def set_columns(target: DataFrame, updates: DataFrame, key: str = "id") -> DataFrame:
    """Partial update: columns that a row of updates has; nulls there set null, rows without an update stay."""
    own = [c for c in updates.columns if c != key]
    joined = target.join(updates.select(key, F.struct(*own).alias("_u")), key, "left")
    hit = F.col("_u").isNotNull()
    return joined.select(*[F.when(hit, F.col(f"_u.{c}")).otherwise(F.col(c)).alias(c) if c in own else F.col(c) for c in target.columns])


def replace_children(children: DataFrame, new: DataFrame, parent: str) -> DataFrame:
    """Children of the parents in `new` give way to its rows."""
    return children.join(new.select(parent).distinct(), parent, "left_anti").unionByName(new, allowMissingColumns=True)


def last_decisions(links: DataFrame) -> DataFrame:
    """(a, b, decision) with a < b: the latest decision on each pair; links has a, b, decision and seq."""
    pairs = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "decision", "seq")
    return pairs.groupBy("a", "b").agg(F.max_by("decision", "seq").alias("decision"))


def reconcile(listed: DataFrame, flags: DataFrame) -> DataFrame:
    """(id, listed, flag) after list (id, seq) and flags (id, flag) are squared: rejects leave the list, listed rows are
    picked, picked rows are listed after the others in id order (new_seq null for old ones)."""
    x = flags.join(listed.withColumn("_on", F.lit(True)), "id", "left")
    on = F.col("_on").isNotNull()
    reject = F.coalesce(F.col("flag") == "reject", F.lit(False))
    pick = F.coalesce(F.col("flag") == "pick", F.lit(False))
    return x.select(
        "id", ((on & ~reject) | pick).alias("listed"), F.when(on & ~reject, "pick").otherwise(F.col("flag")).alias("flag"), (pick & ~on).alias("added"), "seq"
    )


def renamed(df: DataFrame, key: str, old, name: str, **also) -> DataFrame:
    """df with another name in the rows whose key is `old`, and the columns of `also` set to their values there."""
    here = F.col(key).eqNullSafe(F.lit(old))
    values = {"name": name.strip(), **also}
    return df.withColumns({c: F.when(here, F.lit(v)).otherwise(F.col(c)) if c in df.columns else F.when(here, F.lit(v)) for c, v in values.items()})


def fill_missing(target: DataFrame, read: DataFrame, key: str = "id") -> DataFrame:
    """target with the nulls of ok rows filled from a later reading; what is there already stays. A key is read once: of
    repeated readings the first value of each column counts, in the order of values."""
    own = [c for c in read.columns if c != key]
    once = read.groupBy(key).agg(*[F.min(c).alias(f"_{c}") for c in own])
    ok = F.coalesce(F.col("status") == "ok", F.lit(False))
    joined = target.join(once, key, "left")
    return joined.select(*[F.when(ok, F.coalesce(c, f"_{c}")).otherwise(F.col(c)).alias(c) if c in own else F.col(c) for c in target.columns])


def seen_once(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key by `order`; ties go to the smaller row. Minima are aggregated, so no key is gathered."""
    rest = [c for c in df.columns if c not in (key, order)]
    first = df.groupBy(key).agg(F.min(F.struct(order, *rest)).alias("_f"))
    return first.select(*[F.col(key) if c == key else F.col(f"_f.{c}").alias(c) for c in df.columns])
