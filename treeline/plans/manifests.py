"""Manifests, endpoints and log lines derived from the driver's tables, for queries and tests.

Each is Spark SQL over Parquet, and the same in the other dialect for comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_SRC = """select concat(source,'/',lang,'/',cast(doc_id as string),'.txt') path, cast(octet_length({enc}) as bigint) size,
       1700000000+doc_id*60 mtime, {sha} digest from {documents} where doc_id % 13 <> 0"""
_DST = """select concat(source,'/',lang,'/',cast(doc_id as string),'.txt') path, cast(octet_length({enc2}) as bigint) size,
       1700000000+doc_id*60-(doc_id%5) mtime, {sha2} digest
from (select doc_id, source, lang, case when doc_id%7=0 then concat(text,'!') else text end t2
      from {documents} where doc_id % 11 <> 0) x"""
_BIG = """select concat('y',cast(year(l_shipdate) as string),'/o',cast(l_orderkey as string),'/',cast(l_linenumber as string),'.bin') path,
       cast(floor(max(l_extendedprice)*100+0.5) as bigint) * case l_orderkey % 4 when 0 then 0 when 1 then 1 when 2 then 15 else 60 end size,
       1700000000+l_orderkey mtime
from {lineitem} group by year(l_shipdate), l_orderkey, l_linenumber"""
_ENDPOINTS = """select page_id, concat(case page_id%4 when 0 then 'SYNC://' when 1 then 'sync://' when 2 then 'sync:' else 'http://' end,
              regexp_extract(url,'^https?://([^/]+)',1),
              case page_id%3 when 0 then ':9100' when 1 then '' else ':0' end,
              regexp_extract(url,'^https?://[^/]+(/[^?#]*)',1)) endpoint from {pages}"""
_LOG = """select concat('[',cast(event_id as string),'] ', case event_type
  when 'error'    then concat('ERROR ctx=copy path=u',cast(user_id as string),'/',cast(event_id as string),' msg=denied')
  when 'signup'   then concat('START src=/s/u',cast(user_id as string),' dst=/d/u',cast(user_id as string))
  when 'purchase' then concat('DONE files=',cast(user_id as string),' bytes=',cast(event_id*10 as string),' seconds=1.500')
  else concat('COPY src=/s/',cast(event_id as string),' dst=/d/',cast(event_id as string),' bytes=',cast(event_id*7 as string)) end) line
from {events}"""
_KINDS = """select concat(source,'/',lang,'/',cast(doc_id as string)) path,
       case doc_id%3 when 0 then 'dir' when 1 then 'symlink' else 'file' end kind,
       case when doc_id%6 = 1 then '../../latest' when doc_id%6 = 4 then concat('../',lang) end link_target
from {documents}"""
_RESULTS = """select concat('u',cast(user_id as string),'/',cast(event_id as string)) path, 'copy' action, event_type <> 'error' ok,
       case when event_type <> 'error' then event_id*7 else 0 end bytes, case when event_type = 'error' then 'denied' end error,
       cast(user_id % 8 as double) / 4 as seconds from {events}"""

_TEXTS = {"m_src": _SRC, "m_dst": _DST, "m_big": _BIG, "endpoints": _ENDPOINTS, "log_lines": _LOG, "m_kinds": _KINDS, "results": _RESULTS}
_TABLES = ("documents", "lineitem", "pages", "events")


def manifest(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    words = {t: f"parquet.`{sf_dir}/{t}.parquet`" for t in _TABLES}
    words |= {"enc": "encode(text,'utf-8')", "enc2": "encode(t2,'utf-8')", "sha": "sha2(text,256)", "sha2": "sha2(t2,256)"}
    return spark.sql(_TEXTS[name].format(**words))


def oracle(query: str, *names: str) -> str:
    """query with the named manifests before it, for the comparison engine."""
    words = {t: t for t in _TABLES} | {"enc": "encode(text)", "enc2": "encode(t2)", "sha": "sha256(text)", "sha2": "sha256(t2)"}
    ctes = ",\n".join(f"{n} as ({_TEXTS[n].format(**words)})" for n in names)
    return f"with recursive {ctes}\n{query}"


def contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files made of the documents: path, content, size, mtime (seconds)."""
    return spark.sql(
        f"""select concat(source,'/',lang,'/',cast(doc_id as string),'.txt') path, encode(text,'utf-8') content,
                   cast(octet_length(encode(text,'utf-8')) as bigint) size, 1700000000+doc_id*60 mtime, doc_id
            from parquet.`{sf_dir}/documents.parquet`"""
    )
