"""Session plans: automatic selection, edits, checks, warnings and manifests."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sizing import centered_crop, crop_loss, target_size
from ..operators.keyframes import batch_order, decimate, pick_reference, split_budget

UNIT = "struct<kind:string,source:string,ci:int,rank:int,frame:int,rel_alt:double,scale:double>"


def shares(survivors: DataFrame, budgets: DataFrame) -> DataFrame:
    """session, video and share: each session's budget (session, video_budget) split over its videos by survivors (session, video, ci)."""
    counts = survivors.groupBy("session", "video").agg(F.count(F.lit(1)).alias("n")).join(budgets.withColumnRenamed("video_budget", "total"), "session")
    return split_budget(counts).select("session", "video", "share")


def auto_select(survivors: DataFrame, photos: DataFrame, budget: int) -> DataFrame:
    """selection (session, pos, kind, source, ci, source_frame, rel_alt, is_reference): kept photos first, the rest of the budget over the videos.

    survivors: session, video, ci, source_frame, rel_alt; photos: session, path, kept ones alone, in path order.
    """
    chosen = decimate(photos.select("session", "path"), F.lit(budget), ("session",), "path")
    n = chosen.groupBy("session").agg(F.count(F.lit(1)).alias("n"))
    budgets = survivors.select("session").distinct().join(n, "session", "left").select("session", F.greatest(F.lit(budget) - F.coalesce("n", F.lit(0)), F.lit(0)).alias("video_budget"))
    picked = decimate(survivors.join(shares(survivors, budgets), ["session", "video"]), F.col("share"), ("session", "video"))
    videos = picked.select("session", F.lit("video").alias("kind"), F.col("video").cast("string").alias("source"), "ci", "source_frame", "rel_alt")
    none = F.lit(None)
    both = videos.unionByName(chosen.select("session", F.lit("photo").alias("kind"), F.col("path").alias("source"), none.cast("int").alias("ci"), none.cast("int").alias("source_frame"), none.cast("double").alias("rel_alt")))
    order = Window.partitionBy("session").orderBy(F.col("kind") != "video", F.length("source"), "source", "source_frame")
    rows = both.withColumn("pos", F.row_number().over(order) - 1)
    ref = pick_reference(rows).withColumn("is_reference", F.lit(True))
    return rows.join(ref, ["session", "pos"], "left").withColumn("is_reference", F.coalesce("is_reference", F.lit(False)))


def apply_edits(auto: DataFrame, edits: DataFrame, candidates: DataFrame) -> DataFrame:
    """(session, ci, crop_scale, is_reference) after replaying edits (session, seq, op, ci, value) on a session's automatic selection (session, ci, is_reference).

    Edits are include, exclude, crop and reselect, in order of seq; what comes before a session's last reselect is void. Units don't
    depend on each other: windows over a unit's edits give the spans in which it is selected, and its last crop in the last of these.
    Only the reference depends on what else is selected: when it is excluded, it is picked anew from what remains, and including it again
    doesn't undo that. So a session's spans are folded by their ends, and the selection is looked at where the reference goes. Work is
    edits plus selection, and a selection for each change of the reference. candidates (session, ci, rel_alt) give altitudes.
    """
    unit = Window.partitionBy("session", "ci")
    beginning = F.lit(-(1 << 62))
    fresh = edits.withColumn("void", F.max(F.when(F.col("op") == "reselect", F.col("seq"))).over(Window.partitionBy("session"))).where("void is null or seq > void").where("ci is not null and op in ('include', 'exclude', 'crop')")
    events = auto.select("session", "ci", beginning.alias("seq"), F.lit("include").alias("op"), F.lit(None).cast("double").alias("value"))
    events = events.union(fresh.select("session", "ci", F.col("seq").cast("long").alias("seq"), "op", F.col("value").cast("double").alias("value")).join(auto.select("session").distinct(), "session", "left_semi"))
    switch = F.when(F.col("op") != "crop", F.col("op"))
    before = F.last(switch, ignorenulls=True).over(unit.orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    rows = events.withColumn("switch", F.when(switch != F.coalesce(before, F.lit("exclude")), switch))
    after = F.first(F.when(F.col("switch").isNotNull(), F.col("seq")), ignorenulls=True).over(unit.orderBy("seq").rowsBetween(1, Window.unboundedFollowing))
    rows = rows.withColumn("to", after).withColumn("since", F.max(F.when(F.col("switch").isNotNull(), F.col("seq"))).over(unit))

    crop = F.max(F.when((F.col("op") == "crop") & (F.col("seq") > F.col("since")), F.struct("seq", "value")))
    scale = F.when(F.col("crop").isNull(), 1.0).otherwise(F.least(F.greatest(F.col("crop.value"), F.lit(0.3)), F.lit(1.0)))
    last = F.max_by("switch", F.when(F.col("switch").isNotNull(), F.col("seq")))
    selected = rows.groupBy("session", "ci").agg(last.alias("last"), crop.alias("crop")).where("last = 'include'").select("session", "ci", scale.alias("crop_scale"))

    alts = candidates.select("session", "ci", F.col("rel_alt").alias("alt"))
    spans = rows.where("switch = 'include'").join(alts, ["session", "ci"], "left").groupBy("session").agg(F.collect_list(F.struct("to", "ci", F.col("seq").alias("from"), "alt")).alias("spans"))
    first = auto.groupBy("session").agg(F.max(F.when(F.col("is_reference"), F.col("ci"))).alias("first"))

    def pick(sel):
        n = F.size(sel)
        lo = F.floor(n / 4).cast("int")
        hi = F.greatest(F.floor(3 * n / 4).cast("int"), lo + 1)
        mid = F.slice(sel, lo + 1, hi - lo)
        high = F.array_max(F.transform(F.filter(mid, lambda x: x["alt"].isNotNull()), lambda x: F.struct(x["alt"].alias("a"), (-x["ci"]).alias("ci"))))
        return F.coalesce(-high["ci"], F.get(mid, F.floor(F.size(mid) / 2).cast("int"))["ci"])

    def moved(ref, end):
        rest = F.filter("spans", lambda x: (x["from"] < end["to"]) & (x["to"].isNull() | (x["to"] > end["to"])))
        left = F.array_sort(F.transform(rest, lambda x: F.struct(x["ci"].alias("ci"), x["alt"].alias("alt"))))
        return F.when(end["ci"] == ref, F.coalesce(pick(left), ref)).otherwise(ref)

    ends = F.array_sort(F.filter("spans", lambda x: x["to"].isNotNull()))
    refs = spans.join(first, "session").select("session", F.aggregate(ends, F.col("first"), moved).alias("ref"))
    return selected.join(refs, "session").select("session", "ci", "crop_scale", F.coalesce(F.col("ci") == F.col("ref"), F.lit(False)).alias("is_reference"))


def validate(selection: DataFrame, budgets: DataFrame) -> DataFrame:
    """Error and warning codes of each session (session, budget) from its selection (session, is_reference)."""
    rows = budgets.join(selection.groupBy("session").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_reference").alias("refs")), "session", "left")
    n = F.coalesce("n", F.lit(0))
    code = lambda c, name: F.when(c, F.lit(name))
    errors = F.array_compact(F.array(code(n == 0, "nothing selected"), code((n > 0) & (F.col("refs") == 0), "reference not selected")))
    warnings = F.array_compact(F.array(code((n > 0) & (n < 2), "fewer than 2 frames"), code(n > F.col("budget"), "over budget")))
    return rows.select("session", n.alias("n_selected"), errors.alias("errors"), warnings.alias("warnings"))


def session_checks(sessions: DataFrame, frames: DataFrame, cap: int = 1024) -> DataFrame:
    """Error codes of sessions (session, width, height, n_frames) and numbers of missing frames, from uploads frames (session, frame_idx, n_bytes)."""
    j = frames.join(sessions, "session")
    per = j.groupBy("session").agg(F.count_if(~F.col("frame_idx").between(0, F.col("n_frames") - 1)).alias("n_range"), F.count_if(F.col("n_bytes") != F.col("width") * F.col("height") * 3).alias("n_size"), F.count_distinct(F.when(F.col("frame_idx").between(0, F.col("n_frames") - 1), F.col("frame_idx"))).alias("n_there"))
    rows = sessions.join(per, "session", "left").fillna(0, ["n_range", "n_size", "n_there"])
    w, h = F.col("width"), F.col("height")
    bad = (w <= 0) | (h <= 0) | (w % 16 != 0) | (h % 16 != 0)
    code = lambda c, name: F.when(c, F.lit(name))
    errors = F.array_compact(F.array(code(bad, "dimensions"), code(~F.col("n_frames").between(1, cap), "frame count"), code(F.col("n_range") > 0, "frame index"), code(F.col("n_size") > 0, "frame size"), code(F.col("n_there") < F.col("n_frames"), "missing frames")))
    return rows.select("session", errors.alias("errors"), F.greatest(F.col("n_frames") - F.col("n_there"), F.lit(0)).alias("n_missing"))


def footage_warnings(videos: DataFrame, sessions: DataFrame, crops: DataFrame) -> DataFrame:
    """warnings (session, source, code) of videos (session, video, color_transfer, color_md, tonemap), budgets (session, budget, n_photos) and crops (session, source, loss, crop_scale)."""
    row = lambda df, source, code: df.select("session", source.alias("source"), F.lit(code).alias("code"))
    v = F.col("video").cast("string")
    return (
        row(videos.where(F.col("color_transfer").isin("arib-std-b67", "smpte2084")), v, "hdr transfer")
        .unionByName(row(videos.where((F.col("color_md") == "d_log") & (F.col("tonemap") == "none")), v, "log without tonemap"))
        .unionByName(row(sessions.where("n_photos >= budget"), F.lit(None).cast("string"), "photos fill the budget"))
        .unionByName(row(crops.where("loss > 0.01 and crop_scale >= 0.999"), F.col("source"), "crop loss"))
    )


def selection_stats(candidates: DataFrame, selection: DataFrame, budget: int) -> DataFrame:
    """Of each source: candidates, candidates a second, selected; and the session's used share of the budget, at most 1."""
    c = candidates.groupBy("session", "source").agg(F.count(F.lit(1)).alias("n_candidates"), F.max("time_s").alias("last_s"))
    s = selection.groupBy("session", "source").agg(F.count(F.lit(1)).alias("n_selected"))
    used = F.sum("n_selected").over(Window.partitionBy("session"))
    rows = c.join(s, ["session", "source"], "left").fillna(0, ["n_selected"])
    return rows.select("session", "source", "n_candidates", F.try_divide(F.col("n_candidates").cast("double"), F.col("last_s")).alias("per_s"), "n_selected", used.alias("used"), F.greatest(F.lit(budget) - used, F.lit(0)).alias("remaining"), F.least(used / F.lit(float(budget)), F.lit(1.0)).alias("fraction"))


def dominant_source(selection: DataFrame, dims: DataFrame) -> DataFrame:
    """session, source and size of the source with most selected frames; a video beats photos, ties go to the smaller path. dims: session, kind, source, width, height."""
    n = selection.groupBy("session", "kind", "source").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("session").orderBy(F.col("kind") != "video", F.desc(F.when(F.col("kind") == "video", F.col("n")).otherwise(0)), "source")
    return n.withColumn("rn", F.row_number().over(w)).where("rn = 1").join(dims, ["session", "kind", "source"]).select("session", "source", "width", "height")


def preview(manifest_rows: DataFrame, every: int = 4) -> DataFrame:
    """Every k-th frame of a batch, the reference among them."""
    return manifest_rows.where(F.col("batch_index") % every == 0)


def aspect_options(sources: DataFrame) -> DataFrame:
    """Each source's target size (session, source, kind, width, height) with the loss that the other kind's first source would have."""
    tw, th = target_size(F.col("width"), F.col("height"))
    a = sources.select("session", "source", "kind", tw.alias("tw"), th.alias("th"))
    w = Window.partitionBy("session", "kind").orderBy("source")
    first = sources.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("session", F.col("kind").alias("other"), "width", "height")
    j = a.join(first, "session").where("kind <> other")
    crop = centered_crop(F.col("width"), F.col("height"), F.col("tw"), F.col("th"), F.lit(1.0))
    return j.select("session", "source", "tw", "th", crop_loss(F.col("width"), F.col("height"), crop["crop_w"], crop["crop_h"]).alias("loss"))


def build_manifest(selection: DataFrame, details: DataFrame, target_w: int, target_h: int, budget: int) -> DataFrame:
    """A manifest row for each session: frames in batch order with crops; details: session, kind, source, ci, time_s, sharpness, width, height."""
    rows = batch_order(selection).join(details, ["session", "kind", "source"] + (["ci"] if "ci" in details.columns else []), "left")
    crop = centered_crop(F.col("width"), F.col("height"), F.lit(target_w), F.lit(target_h), F.lit(1.0))
    frame = F.struct("batch_index", "source", "kind", "source_frame", "time_s", "sharpness", F.array(*[c.cast("int") for c in crop.values()]).alias("crop"))
    out = rows.groupBy("session").agg(F.sort_array(F.collect_list(frame)).alias("frames"), F.max(F.when(F.col("is_reference"), F.col("pos"))).alias("reference_original_pos"))
    return out.select("session", F.lit(1).alias("version"), F.lit(budget).alias("budget"), "reference_original_pos", "frames")
