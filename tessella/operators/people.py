"""Faces grouped into people, and what is kept of earlier decisions."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.functions.scalars import safe_segment
from tessella.operators.cluster import components, eps_links, kept_names
from tessella.operators.merges import merged_people

EDGE, EYE_SHARP, EPS = 10, 40.0, 0.32
#: Cosine of centroids from which groups are merged without being asked; from 1 on none are.
MERGE_AT = 1.0
#: Faces from which a picture is one of a group.
GROUP_FACES = 3


def good_faces(faces: DataFrame) -> DataFrame:
    """Faces that are large and sharp enough to be grouped; an unknown sharpness counts as none."""
    return faces.filter((F.least("w", "h") >= EDGE) & (F.coalesce("eye_sharp", F.lit(0.0)) >= EYE_SHARP))


def grouped(
    faces: DataFrame, eps: float = EPS, same: DataFrame | None = None, names: DataFrame | None = None, decisions: DataFrame | None = None,
    merge_at: float = MERGE_AT, join: Callable = eps_links,
) -> DataFrame:
    """(id, root, name) of faces (id, w, h, eye_sharp, vector): groups of the graph of cosine distances up to eps, with
    decisions (a, b) that faces are the same as edges too. With decisions (a, b, decision: same or different), groups are merged by
    them, and greedily from a cosine of centroids on, where that is under 1. A group takes the commonest old name (id, name) of its
    faces; a name that won no group takes its faces back out into a group of its own. join: as in cluster.linked_groups()."""
    good = good_faces(faces).select("id", "vector")
    edges = join(good, 1 - eps).select("a", "b")
    if same is not None:
        edges = edges.unionByName(same.select("a", "b"))
    groups = components(edges)
    if decisions is not None:
        groups = merged_people(groups, good, decisions, merge_at)
    if names is None:
        return groups.withColumn("name", F.lit(None).cast("string"))
    won = kept_names(groups, names)
    lost = names.join(won.select("name").distinct(), "name", "left_anti")
    own = lost.withColumn("root", F.min("id").over(Window.partitionBy("name"))).select("id", "root", "name")
    rest = groups.join(own.select("id"), "id", "left_anti").join(won, "root", "left").select("id", "root", "name")
    return rest.unionByName(own)


def listing(groups: DataFrame, faces: DataFrame, chosen: DataFrame | None = None) -> DataFrame:
    """(root, name, n, faces, cover) of each person: photos, faces, and the chosen cover or else the face with the best
    score; most photos first."""
    rows = groups.join(faces.select("id", "photo_id", "score"), "id")
    if chosen is not None:
        rows = rows.join(chosen.select(F.col("id"), F.lit(True).alias("_chosen")), "id", "left")
    rank = F.struct(F.coalesce("_chosen", F.lit(False)) if chosen is not None else F.lit(False), "score", -F.col("id"))
    people = rows.groupBy("root").agg(
        F.first("name", ignorenulls=True).alias("name"), F.countDistinct("photo_id").alias("n"), F.count("*").alias("faces"), F.max_by("id", rank).alias("cover")
    )
    return people.orderBy(F.desc("n"), "root")


def clip_summary(frames: DataFrame) -> DataFrame:
    """(clip, people, face_h) of sampled frames (clip, n_faces, height_share): the median number of faces, rounded down,
    and the median of the largest face's share over frames that have one."""
    return frames.groupBy("clip").agg(
        F.floor(F.percentile("n_faces", F.lit(0.5))).alias("people"), F.median(F.when(F.col("n_faces") > 0, F.col("height_share"))).alias("face_h")
    )


def shot_size(size, face_h):
    """A size corrected by the height of the largest face; close stays close."""
    return F.when(size == "close", size).when(face_h >= 0.45, "close").when(face_h >= 0.15, "medium").when(face_h.isNotNull(), "wide").otherwise(size)


def photo_names(faces: DataFrame, people: DataFrame, items: DataFrame, matches: DataFrame | None = None) -> DataFrame:
    """(photo_id, names) of ok items: the sorted distinct names of people (id, name) on its faces (photo_id, person_id) and of
    references that it matches (photo_id, name). Blanks around names go, and names of nothing else don't count."""
    ok = items.filter("status = 'ok'").select(F.col("id").alias("photo_id"))
    rows = faces.join(people.select(F.col("id").alias("person_id"), "name"), "person_id").select("photo_id", "name")
    if matches is not None:
        rows = rows.unionByName(matches.select("photo_id", "name"))
    rows = rows.select("photo_id", F.trim("name").alias("name")).filter("name <> ''").join(ok, "photo_id", "left_semi")
    return rows.groupBy("photo_id").agg(F.array_sort(F.collect_set("name")).alias("names"))


def person_folders(faces: DataFrame, people: DataFrame, items: DataFrame) -> DataFrame:
    """(folder, photo_id): a row for each person's picture under people/<name>, the number where there is no name, and for ok
    items with three faces or more under `groups` and with one under `solo`. People whose names give the same folder share it."""
    name = F.coalesce(F.nullif("name", F.lit("")), F.format_string("person_%02d", "id"))
    own = people.select(F.col("id").alias("person_id"), F.concat(F.lit("people/"), safe_segment(name)).alias("folder"))
    each = faces.select("person_id", "photo_id").distinct().join(own, "person_id").select("folder", "photo_id")
    crowd = F.when(F.col("n_faces") >= GROUP_FACES, "groups").when(F.col("n_faces") == 1, "solo")
    rest = items.filter("status = 'ok'").select(crowd.alias("folder"), F.col("id").alias("photo_id")).filter("folder IS NOT NULL")
    return each.unionByName(rest)


def numbered_folders(names: DataFrame) -> DataFrame:
    """(name, folder) of saved names (name, seq): a name whose folder is taken by an earlier one gets _2, _3 and so on, whichever
    is free. Only names that are alike but for such numbers can meet, so each such set is numbered by itself."""
    rows = names.groupBy("name").agg(F.min("seq").alias("seq")).withColumn("folder", safe_segment(F.col("name"))).filter("folder IS NOT NULL")

    def number(of: pd.DataFrame) -> pd.DataFrame:
        of, taken, folders = of.sort_values(["seq", "name"]), set(), []
        for first in of["folder"]:
            folder, i = first, 2
            while folder in taken:
                folder, i = f"{first}_{i}", i + 1
            taken.add(folder)
            folders.append(folder)
        return pd.DataFrame({"name": of["name"], "folder": folders})

    return rows.groupBy(F.regexp_replace("folder", r"(_\d+)+$", "").alias("_set")).applyInPandas(lambda key, of: number(of), "name string, folder string")


def with_people(items: DataFrame, *, faces: DataFrame | None = None, person_id: int | None = None, pile: DataFrame | None = None) -> DataFrame:
    """Items that show a person, are on the pile (id) and still ok, or both; all items if neither is asked for."""
    if person_id is not None:
        items = items.join(faces.filter(F.col("person_id") == person_id).select(F.col("photo_id").alias("id")), "id", "left_semi")
    if pile is not None:
        items = items.filter("status = 'ok'").join(pile.select("id"), "id", "left_semi")
    return items


def saved_names(refs: DataFrame, matches: DataFrame) -> DataFrame:
    """(name, reference_ids, sources, count) of references (id, name, source), with the pictures that match each name (name,
    photo_id); a name without a match counts 0. Most matches first."""
    own = F.array_sort(F.collect_list(F.struct("id", "source")))
    rows = refs.groupBy("name").agg(own.alias("r")).join(matches.groupBy("name").agg(F.countDistinct("photo_id").alias("count")), "name", "left")
    return rows.select(
        "name", F.transform("r", lambda x: x["id"]).alias("reference_ids"), F.transform("r", lambda x: x["source"]).alias("sources"), F.coalesce("count", F.lit(0)).alias("count")
    ).orderBy(F.desc("count"), "name")
