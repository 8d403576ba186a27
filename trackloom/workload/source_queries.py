"""Queries over scans whose files are derived from the given tables as text columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackloom.session import shared_folder
from trackloom.sources import files as FS
from trackloom.sources import readers as I
from trackloom.workload import bindings as B
from trackloom.workload.bindings import cte
from trackloom.workload.registry import R, query, r

cte("label_det", "select stem, row_number() over (partition by stem order by case when l_linenumber = 3 then 1e0 else l_quantity end desc, line_no) as detection_rank, "
    "case when l_linenumber = 3 then 1e0 else l_quantity end as bbox_conf, (l_partkey % 1000) / 1000e0 as xc, l_discount as hx, 0.5e0 as tx_, l_linenumber from label_lines", "label_lines")


@query("scan_detections_text", f"select stem as prediction_stem, cast(detection_rank as int) as detection_rank, bbox_conf, {r('xc')} as xc, {r('hx')} as head_x, case when l_linenumber = 4 then null else 0.125e0 end as tail_x from label_det", "label_det")
def scan_detections_text(spark, d):
    out = I.parse_detections(B.label_texts(spark, d))
    return out.select("prediction_stem", F.explode("detections").alias("v")).select(
        "prediction_stem", "v.detection_rank", "v.bbox_conf", R("v.bbox.xc").alias("xc"), R("v.head.x").alias("head_x"), F.col("v.tail.x").alias("tail_x"))


cte("img", "select 'swing_' || (o_orderkey % 1000) || '_' || lpad(cast(o_orderkey as varchar), cast(greatest(9, length(cast(o_orderkey as varchar))) as int), '0') as stem from orders where o_orderkey % 5 <> 0")


@query("scan_frame_population", "select stem as prediction_stem, cast(coalesce(n, 0) as int) as detections from (select stem from img union select distinct 'swing_' || (l_orderkey % 1000) || '_' || lpad(cast(l_orderkey as varchar), cast(greatest(9, length(cast(l_orderkey as varchar))) as int), '0') from lineitem) left join (select stem, count(*) as n from label_det group by stem) using (stem)", "img", "label_det")
def scan_frame_population(spark, d):
    images = B.table(spark, d, "orders").selectExpr(
        "concat('run/swing_', o_orderkey % 1000, '_', lpad(o_orderkey, cast(greatest(9, length(cast(o_orderkey as string))) as int), '0'), case when o_orderkey % 5 = 0 then '.txt' when o_orderkey % 2 = 0 then '.JPG' else '.png' end) as path")
    out = I.frame_population(I.parse_detections(B.label_texts(spark, d)), I.image_paths(images))
    return out.select("prediction_stem", F.size("detections").alias("detections"))


_given = ("run*", "./run3", "run4/labels", "none*")
cte("run_dirs", "select 'run' || (l_orderkey % 7) as run, case when l_orderkey % 7 % 2 = 0 then 'run' || (l_orderkey % 7) || '/labels' else 'run' || (l_orderkey % 7) end as labels, count(*) as lines from lineitem group by all")


@query("scan_globbed_dirs", "select 0 as given_no, run as run_dir, labels as labels_dir, true as first, lines, true as has_files from run_dirs "
       "union all select 1, run, labels, false, 0, true from run_dirs where run = 'run3' union all select 2, run, labels, true, lines, true from run_dirs where run = 'run4'", "run_dirs")
def scan_globbed_dirs(spark, d):
    """A tree of label folders is written, found again by wildcards and plain paths, and read: lines per folder that is not a duplicate."""
    root = shared_folder(spark, "runs")
    lines = B.table(spark, d, "lineitem").select((F.col("l_orderkey") % 7).alias("run"), F.concat_ws(" ", "l_orderkey", "l_linenumber").alias("value"))
    for run in range(7):
        lines.filter(F.col("run") == run).select("value").write.text(f"{root}/run{run}" + ("" if run % 2 else "/labels"))
    found = FS.label_folders(FS.matched_folders(spark, [f"{root}/{g}" for g in _given]))
    folders = [r.labels_dir for r in found.select("labels_dir").distinct().collect()]
    files = FS.file_catalogue(spark, folders, pattern="*.txt").groupBy("folder").agg(F.sum("length").alias("bytes"))
    text = spark.read.text(folders).groupBy(_folder(F.col("_metadata.file_path")).alias("folder")).agg(F.count(F.lit(1)).alias("lines"))
    named = found.withColumn("folder", F.regexp_replace("labels_dir", "^file:/+", "file:/"))
    out = named.join(files, "folder", "left").join(text, "folder", "left")
    short = lambda c: F.regexp_extract(c, r"(run[0-9](/labels)?)/?$", 1).alias(c)
    return out.select("given_no", short("run_dir"), short("labels_dir"), "first", F.when(F.col("first"), F.col("lines")).otherwise(0).alias("lines"), (F.col("bytes") > 0).alias("has_files"))


def _folder(path):
    return F.regexp_replace(F.regexp_replace(path, "^file:/+", "file:/"), "/[^/]*$", "")


@query("fingerprint_files", "select url as path, sha256(html) as sha256 from pages")
def fingerprint_files(spark, d):
    p = B.table(spark, d, "pages").select(F.col("url").alias("path"), F.col("html").cast("binary").alias("content"))
    return I.fingerprints(p)
