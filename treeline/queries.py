"""One query per operator, with the same in SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.functions import paths
from treeline.operators import compare, delta, filters, jobs, report
from treeline.plans import planning, sync
from treeline.plans.manifests import contents, manifest, oracle
from treeline.sinks import new_folder, stored
from treeline.sources import tree

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
LOWER, UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def query(name: str, sql: str | None = None, *tables: str):
    """Registers a function of (spark, sf_dir); with ``sql`` also its counterpart over ``tables``."""

    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = oracle(sql, *tables) if tables else sql
        return f

    return add


def _on(name: str, table: str, sql: str, work: Callable[[DataFrame], DataFrame], *more: str) -> None:
    query(name, sql, table, *more)(lambda s, d: work(manifest(s, d, table)))


def _pair(name: str, sql: str, work: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
    query(name, sql, "m_src", "m_dst")(lambda s, d: work(manifest(s, d, "m_src"), manifest(s, d, "m_dst")))


# Projections -----------------------------------------------------------------------------------

_on("p1_rel_path", "m_src", "select path, case when starts_with(path,'src1/') then substr(path,6) else path end rel from m_src",
    lambda m: m.select("path", paths.rel_path("path", F.lit("src1")).alias("rel")))
_on("p2_dest_path", "m_src", "select path, '/d/' || case when starts_with(path,'src1/') then substr(path,6) else regexp_extract(path,'[^/]*$') end dest from m_src",
    lambda m: m.select("path", paths.dest_path("path", F.lit("src1"), F.lit("/d")).alias("dest")))
_on("p3_base_name", "m_src", "select path, string_split(path,'/')[-1] name from m_src", lambda m: m.select("path", paths.base_name("path").alias("name")))
_on("p4_components", "m_src", "select path, replace(path,'/','|') || '|x' parts from m_src",
    lambda m: m.select("path", F.array_join(paths.components(F.concat(F.lit("./"), F.col("path"), F.lit("//x/."))), "|").alias("parts")))
_on("p5_ancestors", "m_src", """select path, array_to_string(string_split(path,'/')[1:i],'/') ancestor
    from (select path, unnest(range(1, len(string_split(path,'/')))) i from m_src)""",
    lambda m: m.select("path", F.explode(paths.ancestors("path")).alias("ancestor")))
_on("p6_depth", "m_big", "select path, len(string_split(path,'/')) as depth from m_big", lambda m: m.select("path", paths.depth("path").cast("bigint").alias("depth")))

_PARSED = """select page_id, endpoint, h as host, port, case when tail = '' then '/' else tail end path from (
    select page_id, endpoint, split_part(hp,':',1) h, tail,
           case when contains(hp,':') then try_cast(split_part(hp,':',2) as int) else 9031 end port
    from (select page_id, endpoint, regexp_extract(endpoint,'^(?i:sync):(//)?([^/]+)',2) hp,
                 regexp_extract(endpoint,'^(?i:sync):(//)?[^/]+(/.*)$',2) tail from endpoints))
    where h <> '' and port between 1 and 65535"""


def _parsed(m: DataFrame) -> DataFrame:
    return m.select("page_id", "endpoint", paths.parse_endpoint("endpoint").alias("e")).filter("e is not null").select("page_id", "endpoint", "e.*")


_on("p7_parse_endpoint", "endpoints", _PARSED, _parsed)
_on("p8_format_endpoint", "endpoints", f"select page_id, 'sync://' || host || ':' || port || path as formatted from ({_PARSED})",
    lambda m: _parsed(m).select("page_id", paths.format_endpoint(F.col("host"), F.col("port"), F.col("path")).alias("formatted")))
_on("p9_suggest", "m_kinds", "select distinct 'sync://h:9031/' || split_part(path,'/',1) || '/' suggestion from m_kinds", lambda m: tree.suggest(m, "h", 9031))
_on("p10_direction", "endpoints", """select page_id, case when s and d then 'both_remote' when d then 'push' when s then 'pull' else 'local' end direction
    from (select page_id, page_id%4<>3 and page_id%3<>2 s, page_id%2=0 d from endpoints)""",
    lambda m: m.select("page_id", planning.direction(F.col("endpoint"), F.when(F.col("page_id") % 2 == 0, "sync://h/x").otherwise("/x")).alias("direction")))
_on("p11_path_key", "m_src", f"select path, translate(upper(path) || 'É','{UPPER}','{LOWER}') k from m_src",
    lambda m: m.select("path", paths.path_key(F.concat(F.upper("path"), F.lit("É")), True).alias("k")))
_ODD = "case size%4 when 0 then '../'||path when 1 then '/'||path when 2 then './'||path||'//x' else path end"
_ODD_SPARK = _ODD.replace("||", " || ")
_on("p12_safe_path", "m_src", """select path, case when size%4 > 1 then case when size%4=2 then path||'/x' else path end end safe,
    case size%4 when 0 then 'parent' when 1 then 'absolute' end reason from m_src""",
    lambda m: m.select("path", paths.safe_path(F.expr(_ODD_SPARK)).alias("s")).select("path", F.col("s.path").alias("safe"), "s.reason"))
_on("p13_clean_path", "m_src", "select path, case when size%4=2 then path||'/x' else path end as clean from m_src",
    lambda m: m.select("path", paths.clean_path(F.expr(_ODD_SPARK)).alias("clean")))
_on("p14_is_under_root", "m_src", "select path, starts_with(path,'src1/') ok from m_src", lambda m: m.select("path", paths.is_under_root(paths.normalize_path(F.concat(F.lit("src1/../"), F.col("path"), F.lit("/."))), F.lit("src1")).alias("ok")))
_on("p15_normalize_path", "m_src", "select path, case when size%2=0 then '/'||path else '../'||path end normal from m_src",
    lambda m: m.select("path", paths.normalize_path(F.when(F.col("size") % 2 == 0, F.concat(F.lit("/x/../"), F.col("path"), F.lit("/./y/.."))).otherwise(F.concat(F.lit("../"), F.col("path")))).alias("normal")))
_CLASS = "case when size < 1048576 then 'small' when size < 104857600 then 'medium' else 'large' end"
_on("p16_size_class", "m_big", f"select path, {_CLASS} size_class from m_big", lambda m: m.select("path", planning.size_class("size").alias("size_class")))
_on("p17_push_class", "m_big", "select path, case when size < 1000000 then 'small' when size < 268435456 then 'whole' else 'ranged' end push_class from m_big",
    lambda m: m.select("path", planning.push_class("size").alias("push_class")))
_on("p18_human_size", "m_big", "select path, printf('%.2f', size/1048576.0) mb, printf('%.2f', size/1073741824.0) gb from m_big",
    lambda m: m.select("path", paths.human_mb("size").alias("mb"), paths.human_gb("size").alias("gb")))
_on("p19_mtime_sec", "m_src", "select path, case when size%9=0 then 0 else greatest(mtime-1700001000, 0) end s from m_src",
    lambda m: m.select("path", paths.mtime_sec(F.when(F.col("size") % 9 != 0, F.timestamp_seconds(F.col("mtime") - 1700001000))).alias("s")))
_on("p20_guard_roots", "endpoints", "select page_id, not ((page_id%3=0 and page_id%4=0) or (page_id%3=1 and page_id%5=0)) allowed from endpoints",
    lambda m: (lambda jobs_: jobs_[0].withColumn("allowed", F.lit(True)).unionByName(jobs_[1].withColumn("allowed", F.lit(False))))(planning.guard_roots(m.select(
        "page_id", F.expr("case page_id%3 when 0 then 'move' when 1 then 'mirror' else 'copy' end verb"),
        F.expr("case when page_id%4=0 then '/' else '/a' end src"), F.expr("case when page_id%5=0 then 'C:/' else '/b' end dst")))).select("page_id", "allowed"))

# Filters ---------------------------------------------------------------------------------------

_on("f1_exclude_files", "m_src", "select path from m_src where not (path like '%/1%' or path like '%7.txt')", lambda m: filters.exclude_files(m, ["1*", "*7.txt"]).select("path"))
_on("f2_exclude_dirs", "m_src", "select path from m_src where not (path like 'src1/%' or path like '%/fr/%')", lambda m: filters.exclude_dirs(m, ["src1", "fr"]).select("path"))
_on("f3_size_between", "m_src", "select path, size from m_src where size between 500 and 5000", lambda m: filters.size_between(m, 500, 5000).select("path", "size"))
_on("f4_glob_match", "m_src", "select path, true a, contains(path,'/e') b, ends_with(path,'3.txt') c, starts_with(path,'src2') d, path = 'src*1' e from m_src",
    lambda m: m.select("path", *[filters.glob_match(F.col("path"), p).alias(n) for n, p in zip("abcde", ("*", "*/e*", "*3.txt", "src2*", "src*1"), strict=True)]))
_on("f5_link_policy", "m_kinds", "select path, kind from m_kinds where kind <> 'symlink'", lambda m: filters.link_policy(m, drop_links=True).select("path", "kind"))
_on("f5_dir_links", "m_kinds", "select path, kind from m_kinds where kind <> 'symlink' or link_target = '../../latest'",
    lambda m: filters.link_policy(m, drop_dir_links=True).select("path", "kind"))
_on("f6_empty_dirs", "m_kinds", "select path from m_kinds where kind <> 'dir'", lambda m: filters.empty_dirs(m, include=False).select("path"))
_on("f7_files_only", "m_kinds", "select path from m_kinds where kind = 'file'", lambda m: filters.files_only(m).select("path"))
_pair("f8_need_membership", "select path from m_src where path in (select path from m_dst where size > 1000)",
      lambda a, b: compare.need_filter(a, b.filter("size > 1000")).select("path"))
_on("f9_skip_parent", "m_kinds", "select distinct split_part(path,'/',1) as name from m_kinds", lambda m: tree.children_only(tree.list_dir(m)).select("name"))
_on("f10_max_rows", "m_src", "select path from m_src", lambda m: filters.assert_max_rows(m.select("path"), 100_000_000))
query("f11_latest_by_key", """select user_id, event_id from (select user_id, event_id, row_number() over (partition by user_id order by event_id desc) r from events)
    where r = 1 order by event_id desc limit 10""")(
    lambda s, d: filters.latest_by_key(s.read.parquet(f"{d}/events.parquet").select("user_id", "event_id"), "user_id", "event_id", 10))

# Joins -----------------------------------------------------------------------------------------

_NEED = """select s.path, s.size, s.mtime, case when d.path is null then 'missing' when s.size <> d.size then 'size' when s.mtime - d.mtime >= 3 then 'newer' end reason
    from m_src s left join m_dst d using (path)"""
_pair("j1_need_copy", f"select * from ({_NEED}) where reason is not null", lambda a, b: compare.need_copy(a, b).select("path", "size", "mtime", "reason"))
_pair("j1_need_copy_checksum", """select s.path, case when d.path is null then 'missing' when s.size <> d.size then 'size' else 'digest' end reason
    from m_src s left join m_dst d using (path) where d.path is null or s.size <> d.size or s.digest <> d.digest""",
    lambda a, b: compare.need_copy(a, b, "checksum").select("path", "reason"))
_on("j2_need_all", "m_kinds", "select path from m_kinds where kind in ('file','symlink')", compare.need_all)
_pair("j3_need_filter", f"select path from m_src where path in (select path from ({_NEED}) where reason = 'size')",
      lambda a, b: compare.need_filter(a, compare.need_copy(a, b).filter("reason = 'size'")).select("path"))
_pair("j4_extra_files", "select path from m_dst where path not in (select path from m_src)", lambda a, b: compare.extra_files(b, a).select("path"))


def _dirs_too(m: DataFrame) -> DataFrame:
    return m.select("path", F.lit("file").alias("kind")).unionByName(compare.all_dirs(m).withColumn("kind", F.lit("dir")))


_pair("j5_extra_dirs", """select distinct regexp_extract(path,'^(.*)/[^/]*$',1) path from m_dst where ends_with(path,'1.txt')
    and regexp_extract(path,'^(.*)/[^/]*$',1) not in (select regexp_extract(path,'^(.*)/[^/]*$',1) from m_src where size > 9000)
    union select distinct split_part(path,'/',1) from m_dst where ends_with(path,'1.txt')
    and split_part(path,'/',1) not in (select split_part(path,'/',1) from m_src where size > 9000)""",
    lambda a, b: compare.extra_dirs(_dirs_too(b.filter("path like '%1.txt'")), a.filter("size > 9000").withColumn("kind", F.lit("file"))).select("path"))
_pair("j6_pull_extras", """select path, 'file' kind from m_dst where path not in (select path from m_src where size > 9000)
    union all select distinct d, 'dir' from (select split_part(path,'/',1) d from m_dst union select regexp_extract(path,'^(.*)/[^/]*$',1) from m_dst)
    where d not in (select split_part(path,'/',1) from m_dst where path in (select path from m_src where size > 9000)
                    union select regexp_extract(path,'^(.*)/[^/]*$',1) from m_dst where path in (select path from m_src where size > 9000))""",
    lambda a, b: compare.pull_extras(_dirs_too(b), a.filter("size > 9000")))


def _verify_sql(same: str, labels: str = "local") -> str:
    changed, missing, extra = compare.LABELS[labels]
    if labels == "pull":
        missing, extra = extra, missing
    return f"""select case when d.path is null then '{missing}' when s.path is null then '{extra}' else '{changed}' end kind,
      coalesce(s.path, d.path) path, coalesce(s.size,0) size_src, coalesce(d.size,0) size_dest, coalesce(s.mtime,0) mtime_src, coalesce(d.mtime,0) mtime_dest
    from m_src s full join m_dst d on s.path = d.path where s.path is null or d.path is null or not ({same})"""


_pair("j7_verify", _verify_sql("s.digest = d.digest"), lambda a, b: compare.verify(a, b, "checksum"))
_pair("j7_verify_size", _verify_sql("s.size = d.size"), lambda a, b: compare.verify(a, b, "size"))
_pair("j7_verify_size_mtime", _verify_sql("s.size = d.size and abs(s.mtime - d.mtime) < 3"), lambda a, b: compare.verify(a, b, "size_mtime"))
_pair("j8_verify_push", _verify_sql("s.digest = d.digest", "push"), lambda a, b: compare.verify(a, b, "checksum", "push"))
_pair("j9_verify_pull", _verify_sql("s.digest = d.digest", "pull"), lambda a, b: compare.verify(a, b, "checksum", "pull"))
_pair("j10_lookup_hashes", "select s.path, case when d.size%3 = 0 then d.digest end digest from m_src s left join m_dst d using (path)",
      lambda a, b: compare.lookup_hashes(a.select("path"), b.select("path", (F.col("size") % 3).alias("status"), "digest")))
_pair("j11_tree_parity", """select *, files_src = files_dest and bytes_src = bytes_dest equal from
    (select count(*) files_src, cast(sum(size) as bigint) bytes_src from m_src), (select count(*) files_dest, cast(sum(size) as bigint) bytes_dest from m_dst)""", compare.tree_parity)
_pair("j12_fold_collisions", f"""select translate(path,'{UPPER}','{LOWER}') folded, count(*) n, min(path) first_path
    from (select path from m_src union all select upper(path) from m_dst where size%2=0) group by 1 having count(*) > 1""",
    lambda a, b: compare.fold_collisions(a.select("path").union(b.filter("size%2=0").select(F.upper("path").alias("path")))))

# Aggregations ----------------------------------------------------------------------------------

_on("a1_tree_totals", "m_src", "select count(*) files, cast(sum(size) as bigint) bytes from m_src", report.tree_totals)
_on("a2_class_counts", "m_big", f"select {_CLASS} size_class, count(*) files, cast(sum(size) as bigint) bytes from m_big group by 1",
    lambda m: report.class_counts(m.withColumn("size_class", planning.size_class("size"))))
_STATS = "select count(*) filter (ok) files, cast(sum(bytes) filter (ok) as bigint) bytes, count(*) filter (not ok) errors from results"
_on("a3_run_stats", "results", _STATS, report.run_stats)
_on("a4_run_report", "results", f"select files, bytes, errors, printf('%.2f', bytes/1073741824.0) gb, cast(8.0 as double) as seconds, printf('%.2f', bytes/1048576.0/8.0) mb_per_s from ({_STATS})",
    lambda m: report.run_report(m, 8.0))
_CHECKED = _verify_sql("s.digest = d.digest")
_pair("a5_verify_summary", f"""select count(*) = 0 identical, count(*) filter (not starts_with(kind,'extra')) changed_count, count(*) filter (starts_with(kind,'extra')) extras_count,
    (select string_agg(path || '=' || kind, ',' order by path) from (select * from ({_CHECKED}) order by path limit 50)) sample from ({_CHECKED})""",
    lambda a, b: report.verify_summary(compare.verify(a, b, "checksum")).withColumn("sample", F.array_join(F.transform("sample", lambda x: F.concat(x["path"], F.lit("="), x["kind"])), ",")))
_on("a6_average_size", "m_big", "select cast(sum(size)//count(*) as bigint) avg_size from m_big where size < 1048576", lambda m: report.average_size(m.filter("size < 1048576")))


def _doomed(a: DataFrame, b: DataFrame) -> DataFrame:
    extra = compare.extra_files(b, a).select("path")
    return extra.withColumn("kind", F.lit("file")).unionByName(compare.all_dirs(extra).withColumn("kind", F.lit("dir")))


_DOOMED = """select path, 'file' kind from m_dst where path not in (select path from m_src)
    union all select distinct split_part(path,'/',1), 'dir' from m_dst where path not in (select path from m_src)
    union all select distinct regexp_extract(path,'^(.*)/[^/]*$',1), 'dir' from m_dst where path not in (select path from m_src)"""
_pair("a7_delete_counts", f"select kind, count(*) n from ({_DOOMED}) group by kind", lambda a, b: report.delete_counts(_doomed(a, b)))
_on("a9_errors", "results", "select path, action, error from results where not ok", report.errors)
_on("a10_connection_summary", "results", """select count(*) connections, cast(sum(bytes%7) as bigint) files_sent, cast(sum(bytes) as bigint) bytes_sent, cast(0 as bigint) files_received,
    cast(0 as bigint) bytes_received, cast(sum(bytes%11) as bigint) elapsed_ms from results""",
    lambda m: report.connection_summary(m.select(F.expr("concat('Connection summary: files_sent=',bytes%7,', bytes_sent=',bytes,', files_received=0, bytes_received=0, elapsed_ms=',bytes%11) line"))))
_pair("a11_distinct_keys", "select path from m_src union select path from m_dst", compare.key_union)

# Bundles and ranges ----------------------------------------------------------------------------


def _bundled(m: DataFrame) -> DataFrame:
    return planning.assign_bundles(m.select("path", "size"), 50_000, planning.buckets_for(m, 1000, 1_000_000))


_BUNDLED = """select path, size, bucket, cast((upto - size)//50000 as bigint) bundle_id from (
    select path, size, bucket, sum(size) over (order by bucket, path rows unbounded preceding) upto
    from (select path, size, cast('0x' || substr(md5(path),1,8) as bigint) % n bucket
          from m_src, (select greatest(1, (count(*)+999)//1000, cast((sum(size)+999999)//1000000 as bigint)) n from m_src)))"""
_on("a8_bundle_stats", "m_src", f"select bundle_id, count(*) files, cast(sum(size) as bigint) bytes from ({_BUNDLED}) group by bundle_id", lambda m: report.bundle_stats(_bundled(m)))
_on("g1_assign_bundles", "m_src", _BUNDLED, lambda m: _bundled(m))
_on("g2_should_bundle", "m_big", """select count(*) files, cast(sum(size)//count(*) as bigint) avg_size,
    count(*) > case when sum(size)//count(*) < 1024 then 200 when sum(size)//count(*) < 8192 then 500 else 1000 end bundle from m_big where size < 1048576""",
    lambda m: planning.should_bundle(m.filter("size < 1048576")))
_on("r1_split_ranges", "m_big", """select path, off, least(16777216, size-off) len from (select path, size, unnest(range(0, size, 16777216)) off from m_big where size >= 268435456)""",
    planning.split_ranges)

# Digests and deltas ----------------------------------------------------------------------------

BLOCK = 64


def _texts(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Contents of both sides: the second has a byte put before, or one changed at its end."""
    c = contents(s, d)
    return c.select("path", "content"), c.select(
        "path", F.expr("case doc_id%3 when 0 then concat(encode('#','utf-8'), content) when 1 then concat(substring(content,1,length(content)-1), encode('~','utf-8')) else content end").alias("content"))


_B = """b as (select path, cast(k as bigint) block, cast(k*64 as bigint) off, h[k*128+1:(k+1)*128] x from
    (select path, h, unnest(range(0, (len(h)+127)//128)) k from (select concat(source,'/',lang,'/',cast(doc_id as string),'.txt') path, hex(encode(text)) h from documents)))"""
_SIG = f"""with {_B}, v as (select path, block, off, x, cast(len(x)//2 as bigint) n,
    list_transform(range(0, len(x)//2), lambda i: (strpos('0123456789ABCDEF', x[2*i+1])-1)*16 + strpos('0123456789ABCDEF', x[2*i+2])-1 + 31) c from b)
    select path, block, off, n len, cast((list_sum(c) & 65535) + ((list_sum(list_transform(c, lambda y, i: y*(n-i+1))) & 65535) << 16) as bigint) weak, sha256(unhex(x)) strong from v"""
query("h1_file_digest", "select concat(source,'/',lang,'/',cast(doc_id as string),'.txt') path, sha256(text) digest from documents")(
    lambda s, d: contents(s, d).select("path", delta.file_digest(F.col("content")).alias("digest")))
query("h2_digest_md5", "select concat(source,'/',lang,'/',cast(doc_id as string),'.txt') path, md5(text) digest from documents")(
    lambda s, d: contents(s, d).select("path", delta.digest(F.col("content"), "md5").alias("digest")))
query("h2_digest_fast", "select concat(source,'/',lang,'/',cast(doc_id as string),'.txt') path, substr(sha256(text),1,16) digest from documents")(
    lambda s, d: contents(s, d).select("path", delta.digest(F.col("content"), "fast").alias("digest")))
query("h3_weak_checksum", f"select path, block, weak from ({_SIG})")(
    lambda s, d: delta.block_contents(contents(s, d), BLOCK).select("path", "block", delta.weak_checksum(F.col("content")).alias("weak")))
query("h4_rolling_checksums", f"""with {_B}, v as (select path, off, x, len(x)//2 n,
    list_transform(range(0, len(x)//2), lambda i: (strpos('0123456789ABCDEF', x[2*i+1])-1)*16 + strpos('0123456789ABCDEF', x[2*i+2])-1 + 31) c from b),
    e as (select path, off + unnest(range(0, n)) i, cast(unnest(c) as bigint) c from v),
    w as (select path, i, sum(c) over w a, sum(i*c) over w t, count(*) over w n from e window w as (partition by path order by i rows between 63 preceding and current row)),
    r as (select path, cast(a as bigint) a, cast((64 + i - 63) * a - t as bigint) b from w where n = 64)
    select path, count(*) windows, cast(sum((a & 65535) + ((b & 65535) << 16)) as bigint) weak_sum from r group by path""")(
    lambda s, d: delta.rolling_checksums(contents(s, d), BLOCK).groupBy("path").agg(F.count("*").alias("windows"), F.sum("weak").alias("weak_sum")))
query("h5_block_signatures", _SIG)(lambda s, d: delta.block_signatures(contents(s, d).select("path", "content"), BLOCK))


def _need_ranges(s: SparkSession, d: str) -> DataFrame:
    a, b = _texts(s, d)
    return delta.need_ranges(delta.block_signatures(a, BLOCK), delta.block_signatures(b, BLOCK))


def _delta(s: SparkSession, d: str) -> DataFrame:
    a, b = _texts(s, d)
    return delta.delta_match(a, delta.block_signatures(b, BLOCK), BLOCK, 1024)


def _text_trees(s: SparkSession, d: str) -> tuple[str, DataFrame, str, DataFrame]:
    """Roots and manifests of trees of both sides' files."""
    out = []
    for df in _texts(s, d):
        root, rows = new_folder(s, "tree"), df.withColumns({"mtime": F.lit(1_700_000_000), "size": F.length("content")})
        # Contents are shuffled to more tasks only where the table has fewer parts than there are cores.
        few = rows.rdd.getNumPartitions() < s.sparkContext.defaultParallelism
        stored(jobs.write_files(tree.spread(rows) if few else rows, root))
        out += [root, stored(tree.scan_tree(s, root, kinds=("file",)).select("path", "size"))]
    return tuple(out)


def _file_ranges(s: SparkSession, d: str) -> DataFrame:
    a_root, a, b_root, b = _text_trees(s, d)
    return delta.need_ranges(delta.file_signatures(a, a_root, BLOCK, 1000), delta.file_signatures(b, b_root, BLOCK, 1000))


def _file_delta(s: SparkSession, d: str) -> DataFrame:
    a_root, a, b_root, b = _text_trees(s, d)
    return delta.file_delta(a, a_root, delta.file_signatures(b, b_root, BLOCK), BLOCK, 1024)


_CUT2 = """(select path, k, h[k*128+1:(k+1)*128] x, len(h[k*128+1:(k+1)*128])//2 n from (select path, h, unnest(range(0, (len(h)+127)//128)) k from {0}))"""
_BOTH = f"""t as (select concat(source,'/',lang,'/',cast(doc_id as string),'.txt') path, hex(encode(text)) h, doc_id from documents),
    u as (select path, case doc_id%3 when 0 then '23' || h when 1 then h[1:len(h)-2] || '7E' else h end h from t)"""
_RANGES = f"""with {_BOTH}, a as {_CUT2.format("t")}, b as {_CUT2.format("u")},
    n as (select a.path, a.k, a.n, a.k - row_number() over (partition by a.path order by a.k) r from a left join b using (path, k) where b.x is null or a.x <> b.x)
    select path, cast(min(k)*64 as bigint) off, cast(sum(n) as bigint) len from n group by path, r"""
query("h6_need_ranges", _RANGES)(_need_ranges)
query("h6_need_ranges_of_files", _RANGES)(_file_ranges)
query("h5_file_signatures", _SIG)(lambda s, d: (lambda t: delta.file_signatures(t[1], t[0], BLOCK, 1000))(_text_trees(s, d)))
_MATCHES = f"""{_BOTH}, b as (select path, x, min(k*64) dst_off from {_CUT2.format("u")} where n = 64 group by path, x),
    w as (select path, h, unnest(range(0, len(h)//2 - 63)) off from t),
    m as materialized (select w.path, w.off, b.dst_off from w join b on w.path = b.path and h[off*2+1:off*2+128] = b.x)"""
query("h4_rolling_hits", f"with {_MATCHES} select path, off from m")(
    lambda s, d: (lambda a, b: delta.matched_windows(a, delta.block_signatures(b, BLOCK), BLOCK).select("path", "off"))(*_texts(s, d)))
_DELTA = f"""with recursive {_MATCHES},
    g as (select path, min(off) off from m group by path union all select g.path, min(m.off) from g join m on m.path = g.path and m.off >= g.off + 64 group by g.path, g.off),
    c as (select g.path, g.off, dst_off, coalesce(lag(g.off + 64) over (partition by g.path order by g.off), 0) done from g join m on m.path = g.path and m.off = g.off)
    select path, off, cast(64 as bigint) len, dst_off from c union all select path, done, off - done, null from c where off > done
    union all select path, done, n - done, null from (select t.path, len(h)//2 n, coalesce((select max(off) + 64 from g where g.path = t.path), 0) done from t) where n > done"""
query("h7_delta_match", _DELTA)(_delta)
query("h7_delta_of_files", _DELTA)(_file_delta)

# Sorts, limits ---------------------------------------------------------------------------------

_on("l1_sort_listing", "m_kinds", "select distinct split_part(path,'/',2) as name, true is_dir from m_kinds",
    lambda m: planning.sort_listing(m.select(F.split_part("path", F.lit("/"), F.lit(2)).alias("name"), F.lit(True).alias("is_dir")).distinct()))
_on("l2_delete_order", "m_src", "select distinct d as path, len(string_split(d,'/')) as depth from (select split_part(path,'/',1) d from m_src union select regexp_extract(path,'^(.*)/[^/]*$',1) from m_src)",
    lambda m: planning.delete_order(compare.all_dirs(m)).withColumn("depth", F.col("depth").cast("bigint")))
_pair("l3_sample_diff", f"select kind, path from ({_CHECKED}) order by path limit 50", lambda a, b: planning.sample_diff(compare.verify(a, b, "checksum"), 50).select("kind", "path"))
_on("l4_preview", "m_big", f"""select rank, size_class, path, size, (select count(*) from m_big)-20 more from
    (select {_CLASS} size_class, path, size, case when size < 1048576 then 0 when size < 104857600 then 1 else 2 end rank from m_big) order by rank, path limit 20""",
    lambda m: planning.preview(m.withColumn("size_class", planning.size_class("size"))))
_pair("l5_preview_deletes", f"""select kind, r as rank, path, greatest(n-10,0) more from (select kind, path, row_number() over (partition by kind order by path) r, count(*) over (partition by kind) n from ({_DOOMED}))
    where r <= 10""", lambda a, b: planning.preview_deletes(_doomed(a, b)))
_on("l6_listing_limit", "m_kinds", "select '..' as name union all select * from (select distinct split_part(path,'/',1) from m_kinds order by 1 limit 2)",
    lambda m: tree.list_dir(m, limit=3).select("name"))

# Sets ------------------------------------------------------------------------------------------

_pair("u1_union", "select path from m_src union select path from m_dst", compare.key_union)
_pair("u2_difference", "select path from m_dst except select path from m_src", lambda a, b: compare.key_difference(b, a))
_pair("u3_intersection", "select path from m_src intersect select path from m_dst", compare.key_intersection)
_on("u4_distinct_dirs", "m_src", "select split_part(path,'/',1) path from m_src union select regexp_extract(path,'^(.*)/[^/]*$',1) from m_src", compare.all_dirs)
_on("u5_class_order", "m_big", f"select path, {_CLASS} size_class, case when size < 1048576 then 0 when size < 104857600 then 1 else 2 end rank from m_big",
    lambda m: planning.in_class_order(m.withColumn("size_class", planning.size_class("size"))).select("path", "size_class", "rank"))

# Sources over trees made of the documents ------------------------------------------------------

_NAMES = "concat(source,'/',lang,'/',cast(doc_id as string),'.txt')"


def _tree(s: SparkSession, d: str, where: str = "true", change: bool = False) -> str:
    """The root of a tree of the documents' files, in the shared folder."""
    root = new_folder(s, "tree")
    rows = contents(s, d).filter(where)
    if change:
        rows = rows.withColumn("content", F.expr("case when doc_id%7=0 then concat(content, encode('!','utf-8')) else content end"))
    stored(jobs.write_files(tree.spread(rows), root))
    return root


def _scan(s: SparkSession, root: str, **more) -> DataFrame:
    return tree.manifest_seconds(tree.scan_tree(s, root, **more))


_FILES = f"select {_NAMES} path, cast(octet_length(encode(text)) as bigint) size, 1700000000+doc_id*60 mtime from documents"
query("s1_scan_tree", _FILES)(lambda s, d: _scan(s, _tree(s, d), kinds=("file",)).select("path", "size", "mtime"))


@query("s2_scan_follow_links", f"""select case when doc_id % 10 = 0 then 'links/' || doc_id else {_NAMES} end path, cast(octet_length(encode(text)) as bigint) size from documents""")
def _s2(s: SparkSession, d: str) -> DataFrame:
    """Links to every tenth file, which are its shortest route, and from each source back to the top."""
    root = _tree(s, d)
    rows = contents(s, d)
    links = rows.filter("doc_id % 10 = 0").selectExpr("concat('links/', doc_id) path", "concat('../', path) link_target")
    links = links.unionByName(rows.selectExpr("concat(split_part(path, '/', 1), '/back') path", "'..' link_target").distinct())
    stored(jobs.run_copy(stored(links.selectExpr("path", "'symlink' kind", "link_target", "cast(0 as bigint) size")), root, root))
    return tree.scan_tree(s, root, follow_links=True, kinds=("file",)).select("path", "size")


@query("s2_scan_linked_folders", f"""select case when source < 'src2' then 'a/' || source || '/' || lang || '/' || doc_id || '.txt'
    else 'deep/down/' || {_NAMES} end path, cast(octet_length(encode(text)) as bigint) size from documents""")
def _s2_folders(s: SparkSession, d: str) -> DataFrame:
    """The files lie outside the root, behind links to folders: a/<source> for some sources (which is their
    shortest route), one link to the folder of all sources further down, and links in circles."""
    base = new_folder(s, "tree")
    rows = contents(s, d)
    stored(jobs.write_files(tree.spread(rows), f"{base}/elsewhere"))
    links = rows.selectExpr("split_part(path, '/', 1) source").distinct()
    near = links.filter("source < 'src2'").selectExpr("concat('a/', source) path", "concat('../../elsewhere/', source) link_target")
    more = s.createDataFrame([("deep/down", "../../elsewhere"), ("deep/again", "../deep"), ("deep/up", "..")], "path string, link_target string")
    stored(jobs.run_copy(stored(near.unionByName(more).selectExpr("path", "'symlink' kind", "link_target", "cast(0 as bigint) size")), f"{base}/root", f"{base}/root"))
    return tree.scan_tree(s, f"{base}/root", follow_links=True, kinds=("file",)).select("path", "size")


query("s3_scan_manifest", f"select path, 'file' kind from ({_FILES}) union all select distinct source, 'dir' from documents union all select distinct source||'/'||lang, 'dir' from documents")(
    lambda s, d: tree.scan_tree(s, _tree(s, d)).select("path", "kind"))
query("s4_scan_filtered", f"select path, size from ({_FILES}) where path not like '%/fr/%' and path not like '%7.txt' and size >= 500")(
    lambda s, d: tree.scan_tree(s, _tree(s, d), filters.FilterSpec(("*7.txt",), ("fr",), 500), kinds=("file",)).select("path", "size"))
_on("s5_list_dir", "m_kinds", "select '..' as name, true is_dir, false truncated union all select distinct split_part(path,'/',2), true, false from m_kinds where starts_with(path,'src1/')",
    lambda m: tree.list_dir(m, "src1"))
_on("s6_expand_tree", "m_kinds", "select path, kind from m_kinds where starts_with(path,'src1/')", lambda m: tree.expand_tree(m, "src1").select("path", "kind"))
_on("s6_expand_edges", "m_kinds", "select path, kind from m_kinds where starts_with(path,'src1/') union select distinct 'src1/' || split_part(path,'/',2), 'dir' from m_kinds where starts_with(path,'src1/')",
    lambda m: tree.expand_edges(tree.edges(m), "src1"))
query("s7_read_content", f"select {_NAMES} path, sha256(text) digest from documents")(
    lambda s, d: tree.read_content(tree.scan_tree(s, _tree(s, d))).select("path", F.sha2("content", 256).alias("digest")))
query("s9_endpoint_column", _PARSED, "endpoints")(lambda s, d: _parsed(manifest(s, d, "endpoints")))
_on("s10_read_log", "log_lines", """select regexp_extract(line,'^.([^]]*)',1) ts, regexp_extract(line,'^[^ ]+ ([A-Z]+) ',1) tag,
    nullif(regexp_extract(line,' src=(.*?) dst=',1),'') src, nullif(regexp_extract(line,' dst=([^ ]*)',1),'') dst, nullif(regexp_extract(line,' path=(.*?) msg=',1),'') path,
    nullif(regexp_extract(line,' ctx=(.*?) path=',1),'') ctx, nullif(regexp_extract(line,' msg=(.*)$',1),'') msg, try_cast(nullif(regexp_extract(line,' files=([0-9]+)',1),'') as bigint) files,
    try_cast(nullif(regexp_extract(line,' bytes=([0-9]+)',1),'') as bigint) bytes, try_cast(nullif(regexp_extract(line,' seconds=([0-9.]+)',1),'') as double) as seconds from log_lines""", tree.parse_log)

# Side effects over trees made of the documents --------------------------------------------------

_DONE = f"select path, true ok, size bytes from ({_FILES})"


def _after(s: SparkSession, results: DataFrame) -> DataFrame:
    return stored(results).select("path", "ok", "bytes")


def _plan(s: SparkSession, root: str) -> DataFrame:
    return stored(_scan(s, root, kinds=("file",)))


@query("k1_copy", _DONE)
def _k1(s: SparkSession, d: str) -> DataFrame:
    root = _tree(s, d)
    return _after(s, jobs.run_copy(_plan(s, root), root, new_folder(s, "copy")))


@query("k2_copy_ranges", _DONE + " where size > 0")
def _k2(s: SparkSession, d: str) -> DataFrame:
    root = _tree(s, d)
    plan = _plan(s, root).filter("size > 0")
    return _after(s, jobs.run_copy_ranges(plan, planning.split_ranges(plan, 4096, 0), root, new_folder(s, "ranges")))


@query("k2_repeat_ranges", f"select {_NAMES} path, sha256(text) digest, 1700000000+doc_id*60 mtime, doc_id % 3 <> 0 first_ok, true again_ok from documents where octet_length(encode(text)) > 0")
def _k2_repeat(s: SparkSession, d: str) -> DataFrame:
    """A run over a source in which every third file is away fails there; a repeat with the same journal,
    when they are back, copies these alone, and all contents are right."""
    root, out, journal = _tree(s, d), new_folder(s, "ranges"), new_folder(s, "journal")
    plan = stored(_plan(s, root).filter("size > 0"))
    ranges = planning.split_ranges(plan, 1000, 0)
    away = stored(plan.filter("cast(regexp_extract(path, '([0-9]+).txt', 1) as int) % 3 = 0").select("path", F.lit("file").alias("kind")))
    stored(jobs.run_delete(away, root))
    first = stored(jobs.run_copy_ranges(plan, ranges, root, out, journal)).select("path", F.col("ok").alias("first_ok"))
    back = contents(s, d).join(away.select("path"), "path", "left_semi")
    stored(jobs.write_files(tree.spread(back), root))
    again = stored(jobs.run_copy_ranges(plan, ranges, root, out, journal)).select("path", F.col("ok").alias("again_ok"))
    found = stored(_scan(s, out, kinds=("file",)))
    digests = tree.tree_digests(found, out).join(found.select("path", "mtime"), "path")
    return digests.join(first, "path").join(again, "path").select("path", "digest", "mtime", "first_ok", "again_ok")


@query("k3_copy_one", f"select path, true ok, size bytes from ({_FILES}) order by path limit 1")
def _k3(s: SparkSession, d: str) -> DataFrame:
    root = _tree(s, d)
    return _after(s, jobs.run_copy(_plan(s, root).orderBy("path").limit(1), root, new_folder(s, "one")))


@query("k4_preallocate", f"select path, size, mtime from ({_FILES})")
def _k4(s: SparkSession, d: str) -> DataFrame:
    out = new_folder(s, "sized")
    stored(jobs.preallocate(tree.spread(contents(s, d)), out))
    return _scan(s, out, kinds=("file",)).select("path", "size", "mtime")


@query("k5_write_ranges", f"select {_NAMES} path, sha256(text) digest from documents where octet_length(encode(text)) > 0")
def _k5(s: SparkSession, d: str) -> DataFrame:
    root, out = _tree(s, d), new_folder(s, "ranges")
    plan = _plan(s, root).filter("size > 0")
    stored(jobs.preallocate(plan, out))
    stored(jobs.write_ranges(planning.split_ranges(plan, 1000, 0), root, out))
    return tree.tree_digests(tree.scan_tree(s, out), out)


query("k6_write_files", f"select path, size, mtime from ({_FILES})")(lambda s, d: _scan(s, _tree(s, d), kinds=("file",)).select("path", "size", "mtime"))


@query("k7_make_dirs", "select distinct source||'/'||lang path from documents union select distinct source from documents")
def _k7(s: SparkSession, d: str) -> DataFrame:
    out = new_folder(s, "dirs")
    stored(jobs.make_dirs(compare.all_dirs(contents(s, d)), out))
    return tree.scan_tree(s, out, kinds=("dir",)).select("path")


@query("k8_symlinks", "select path, link_target from m_kinds where kind = 'symlink'", "m_kinds")
def _k8(s: SparkSession, d: str) -> DataFrame:
    out = new_folder(s, "links")
    stored(jobs.run_copy(manifest(s, d, "m_kinds").filter("kind = 'symlink'").withColumn("size", F.lit(0)), out, out))
    return tree.scan_tree(s, out, kinds=("symlink",)).select("path", "link_target")


def _deleted(s: SparkSession, d: str, **more) -> DataFrame:
    root = _tree(s, d)
    gone = stored(tree.scan_tree(s, root).filter("path not like 'src1%'").select("path", "kind"))
    stored(jobs.run_delete(gone, root, **more))
    return tree.scan_tree(s, root).select("path", "kind")


_LEFT = f"""select path, 'file' kind from ({_FILES}) where path like 'src1%' union select distinct source, 'dir' from documents where source like 'src1%'
    union select distinct source||'/'||lang, 'dir' from documents where source like 'src1%'"""
query("k9_delete", _LEFT)(_deleted)


@query("k10_delete_readonly", f"select {_NAMES} path, doc_id % 3 = 0 readonly, source not like 'src1%' deleted from documents")
def _k10(s: SparkSession, d: str) -> DataFrame:
    root = new_folder(s, "tree")
    rows = contents(s, d).withColumn("mode", F.expr("case when doc_id % 3 = 0 then 292 else 420 end"))  # r--r--r--, rw-r--r--
    stored(jobs.write_files(tree.spread(rows), root))
    before = stored(tree.scan_tree(s, root, kinds=("file",)).select("path", "kind", "readonly"))
    done = stored(jobs.run_delete(before.filter("path not like 'src1%'").select("path", "kind"), root, clear_readonly=True)).filter("ok")
    left = tree.scan_tree(s, root, kinds=("file",)).select("path", F.lit(True).alias("left"))
    both = before.join(done.select("path", "ok"), "path", "left").join(left, "path", "left")
    return both.select("path", "readonly", (F.coalesce("ok", F.lit(False)) & F.isnull("left")).alias("deleted"))




@query("k11_remove_subtree", f"select path from ({_FILES}) where path not like 'src2/%'")
def _k11(s: SparkSession, d: str) -> DataFrame:
    root = _tree(s, d)
    stored(jobs.run_delete(stored(tree.expand_tree(tree.scan_tree(s, root), "src2").select("path", "kind")), root))
    return tree.scan_tree(s, root, kinds=("file",)).select("path")


def _packed(s: SparkSession, d: str) -> tuple[DataFrame, str]:
    root, out = _tree(s, d), new_folder(s, "bundles")
    plan = stored(_plan(s, root))
    return stored(jobs.write_bundles(planning.assign_bundles(plan, 100_000, planning.buckets_for(plan, 1000, 1_000_000)), root, out)), out


_PACKED = _BUNDLED.replace("m_src", f"({_FILES})").replace("50000", "100000")
query("k12_write_bundles", f"select path, bundle_id, size, mtime, true ok from ({_PACKED.replace('path, size,', 'path, mtime, size,')})")(
    lambda s, d: jobs.bundle_index(s, _packed(s, d)[1]).select("path", "bundle_id", "size", F.floor(F.col("mtime_us") / 1_000_000).alias("mtime"), F.isnull("error").alias("ok")))
query("k12_bundle_totals", f"select bundle_id, count(*) files, cast(sum(size) as bigint) bytes, true ok from ({_PACKED}) group by bundle_id")(
    lambda s, d: _packed(s, d)[0].select("bundle_id", "files", "bytes", F.isnull("error").alias("ok")))
_FORK = f"""select path, 'file' kind, size, null link_target, sha256(text) digest from (select {_NAMES} path, cast(octet_length(encode(text)) as bigint) size, text from documents)
    union all select distinct source, 'dir', 0, null, null from documents union all select distinct source||'/'||lang, 'dir', 0, null, null from documents
    union all select distinct source||'/to_'||lang, 'symlink', 0, lang, null from documents"""


def _bundled_tree(s: SparkSession, d: str) -> tuple[str, str]:
    """A tree with a link to each language's folder, and the folder of its bundles."""
    root, out = _tree(s, d), new_folder(s, "bundles")
    links = contents(s, d).selectExpr("concat(split_part(path, '/', 1), '/to_', split_part(path, '/', 2)) path", "split_part(path, '/', 2) link_target").distinct()
    stored(jobs.run_copy(stored(links.selectExpr("path", "'symlink' kind", "link_target", "cast(0 as bigint) size")), root, root))
    plan = stored(tree.scan_tree(s, root))
    jobs.write_bundles(planning.assign_bundles(plan, 100_000, planning.buckets_for(plan, 1000, 1_000_000)), root, out)
    return root, out


query("k13_bundle_tree", _FORK)(
    lambda s, d: tree.read_bundles(s, _bundled_tree(s, d)[1]).select("path", "kind", "size", "link_target", F.sha2("content", 256).alias("digest")))


@query("k13_unpack_tree", _FORK)
def _k13(s: SparkSession, d: str) -> DataFrame:
    """The whole tree from its bundles again: files, folders, links."""
    folder, out = _bundled_tree(s, d)[1], new_folder(s, "unpacked")
    stored(jobs.unpack_bundles(tree.bundle_members(s, folder), folder, out))
    m = stored(tree.scan_tree(s, out))
    return m.join(tree.tree_digests(m, out), "path", "left").select("path", "kind", "size", "link_target", "digest")


query("s8_read_bundles", f"select {_NAMES} path, cast(octet_length(encode(text)) as bigint) size, 1700000000+doc_id*60 mtime, sha256(text) digest from documents")(
    lambda s, d: tree.read_bundles(s, _packed(s, d)[1]).select("path", "size", "mtime", F.sha2("content", 256).alias("digest")))


def _diff(s: SparkSession, d: str) -> DataFrame:
    return compare.verify(manifest(s, d, "m_src"), manifest(s, d, "m_dst"), "checksum")


@query("k14_diff_csv", f'select kind as "type", path, size_src, size_dest, mtime_src, mtime_dest from ({_CHECKED})', "m_src", "m_dst")
def _k14(s: SparkSession, d: str) -> DataFrame:
    out = new_folder(s, "csv")
    report.write_diff_csv(_diff(s, d), out)
    schema = "type string, path string, size_src bigint, size_dest bigint, mtime_src bigint, mtime_dest bigint"
    return s.read.schema(schema).option("header", True).option("escape", '"').csv(out)


query("k15_summary_json", f"""select '{{"identical":' || (count(*)=0) || ',"changed_count":' || count(*) filter (not starts_with(kind,'extra')) || ',"extras_count":' || count(*) filter (starts_with(kind,'extra'))
    || ',"sample":[' || (select coalesce(string_agg('{{"path":"' || path || '","kind":"' || kind || '","size_src":' || size_src || ',"size_dest":' || size_dest || ',"mtime_src":' || mtime_src
    || ',"mtime_dest":' || mtime_dest || '}}', ',' order by path), '') from (select * from ({_CHECKED}) order by path limit 50)) || ']}}' as json from ({_CHECKED})""", "m_src", "m_dst")(
    lambda s, d: report.summary_json(report.verify_summary(_diff(s, d))))
query("k16_summary_text", f"""select 0 as n, 'identical=' || (count(*)=0) || ' changed=' || count(*) filter (not starts_with(kind,'extra')) || ' extras=' || count(*) filter (starts_with(kind,'extra')) as line from ({_CHECKED})
    union all select cast(row_number() over (order by path) as int), kind || ' ' || path from (select * from ({_CHECKED}) order by path limit 5)""", "m_src", "m_dst")(
    lambda s, d: report.summary_text(report.verify_summary(_diff(s, d)), 5))


@query("k17_write_log", """select '[t] ' || case when ok then 'COPY src=/s/' || path || ' dst=/d/' || path || ' bytes=' || bytes else 'ERROR ctx=copy path=' || path || ' msg=denied' end as line from results""", "results")
def _k17(s: SparkSession, d: str) -> DataFrame:
    out = new_folder(s, "log")
    report.write_log(manifest(s, d, "results"), out, "/s", "/d", F.lit("t"))
    return s.read.text(out).withColumnRenamed("value", "line")


# Verbs -----------------------------------------------------------------------------------------



def _two(s: SparkSession, d: str) -> tuple[str, str]:
    return _tree(s, d, "doc_id % 13 <> 0"), _tree(s, d, "doc_id % 11 <> 0", change=True)


def _digests(s: SparkSession, root: str) -> DataFrame:
    return tree.tree_digests(stored(tree.scan_tree(s, root, kinds=("file",))), root)


_SRC_TEXT = f"select {_NAMES} path, sha256(text) digest from documents where doc_id % 13 <> 0"
_DST_ONLY = f"select {_NAMES} path, sha256(case when doc_id%7=0 then text||'!' else text end) digest from documents where doc_id % 13 = 0 and doc_id % 11 <> 0"


def _verb(verb: Callable) -> Callable:
    def run(s: SparkSession, d: str) -> DataFrame:
        a, b = _two(s, d)
        stored(verb(s, a, b))
        return _digests(s, b)

    return run


query("w1_copy", f"{_SRC_TEXT} union all {_DST_ONLY}")(_verb(sync.copy))
query("w2_update", f"{_SRC_TEXT} union all {_DST_ONLY}")(_verb(sync.update))
query("w3_mirror", _SRC_TEXT)(_verb(sync.mirror))
@query("w3_mirror_conflicts", _SRC_TEXT + " union all select 'kept', sha256('outside')")
def _w3_conflicts(s: SparkSession, d: str) -> DataFrame:
    """Mirror onto a destination with links to a folder elsewhere in place of one language's folders, folders in
    place of some files and files in place of one source's folder; what is elsewhere stays as it is."""
    root, base = _tree(s, d, "doc_id % 13 <> 0"), new_folder(s, "tree")
    rows = contents(s, d)
    bytes_of = lambda t: F.encode(F.lit(t), "utf-8")
    odd = rows.filter("doc_id % 7 = 0 and path not like '%/en/%' and path not like 'src1/%'").select(F.concat("path", F.lit("/below")).alias("path"))
    odd = odd.unionByName(s.createDataFrame([("src1",)], "path string"))
    stored(jobs.write_files(odd.select("path", bytes_of("odd").alias("content"), F.lit(5).alias("mtime")), f"{base}/dst"))
    stored(jobs.write_files(s.range(1).select(F.lit("kept").alias("path"), bytes_of("outside").alias("content"), F.lit(5).alias("mtime")), f"{base}/outside"))
    links = rows.filter("path like '%/en/%' and path not like 'src1/%'").selectExpr("concat(split_part(path, '/', 1), '/en') path").distinct()
    stored(jobs.run_copy(stored(links.selectExpr("path", "'symlink' kind", "'../../outside' link_target", "cast(0 as bigint) size")), base, f"{base}/dst"))
    stored(sync.mirror(s, root, f"{base}/dst"))
    return _digests(s, f"{base}/dst").unionByName(_digests(s, f"{base}/outside"))


query("w4_move", _SRC_TEXT)(_verb(lambda s, a, b: sync.move(s, a, b, confirm=True)))
query("w5_verify", """select case when s.path is null then 'extra_dest' when d.path is null then 'missing_dest' else 'changed' end kind, coalesce(s.path, d.path) path
    from m_src s full join m_dst d on s.path = d.path where s.path is null or d.path is null or s.digest <> d.digest""", "m_src", "m_dst")(
    lambda s, d: sync.verify(s, *_two(s, d), "checksum").select("kind", "path"))
_pair("w6_push_plan", f"""select path, reason, case when size * 20011 < 1000000 then 'small' when size * 20011 < 268435456 then 'whole' else 'ranged' end push_class
    from ({_NEED}) where reason is not null and path not like 'src1/%'""",
      lambda a, b: sync.push_plan(*(m.withColumn("size", F.col("size") * 20011).withColumn("kind", F.lit("file")) for m in (a, b)), filters.FilterSpec((), ("src1",))).select("path", "reason", "push_class"))
_pair("w7_pull_plan", f"select path, 'write' action from ({_NEED}) where reason is not null union all select path, 'delete' from m_dst where path not in (select path from m_src)",
      lambda a, b: sync.pull_plan(a.withColumn("kind", F.lit("file")), b.withColumn("kind", F.lit("file"))).select("path", "action"))
_WANTED = "select s.path, s.size from m_src s left join m_dst d using (path) where d.path is null or d.size <> s.size"


def _dirs_sql(m: str) -> str:
    return f"select split_part(path,'/',1) path from {m} union select regexp_extract(path,'^(.*)/[^/]*$',1) from {m}"


_GONE = f"select path, 'file' kind from m_dst where path not in (select path from m_src) union all select path, 'dir' from ({_dirs_sql('m_dst')} except ({_dirs_sql('m_src')}))"


@query("w8_dry_run", f"""select 'classes' part, {_CLASS} as name, count(*) n, cast(sum(size) as bigint) m from ({_WANTED}) group by 2
    union all (select 'files', path, size, greatest((select count(*) from ({_WANTED})) - 20, 0)
        from ({_WANTED}) order by case when size < 1048576 then 0 when size < 104857600 then 1 else 2 end, path limit 20)
    union all select 'delete_counts', kind, count(*), 0 from ({_GONE}) group by kind
    union all select 'deletes ' || kind, path, r, greatest(n - 10, 0) from (
        select kind, path, row_number() over (partition by kind order by path) r, count(*) over (partition by kind) n from ({_GONE})) where r <= 10
    union all select 'totals', '', count(*), cast(sum(size) as bigint) from ({_WANTED})""", "m_src", "m_dst")
def _w8(s: SparkSession, d: str) -> DataFrame:
    """All five tables of a dry run, one below the other."""
    t = sync.dry_run(s, *_two(s, d))
    parts = [
        t["classes"].selectExpr("'classes' part", "size_class name", "files n", "bytes m"),
        t["files"].selectExpr("'files' part", "path name", "size n", "more m"),
        t["delete_counts"].selectExpr("'delete_counts' part", "kind name", "n", "cast(0 as bigint) m"),
        t["deletes"].selectExpr("concat('deletes ', kind) part", "path name", "rank n", "more m"),
        t["totals"].selectExpr("'totals' part", "'' name", "files n", "bytes m"),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]).unionByName(parts[4])
