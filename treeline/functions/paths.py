"""Path, endpoint, size and time expressions.  All are Columns, evaluated inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_PORT = 9031
SCHEME = "sync"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def rel_path(path: Column | str, root: Column) -> Column:
    """path without root; path itself where it isn't below root."""
    p, lead = _col(path), F.concat(root, F.lit("/"))
    return F.when(F.startswith(p, lead), F.substring(p, F.length(lead) + 1, F.length(p))).otherwise(p)


def base_name(path: Column | str) -> Column:
    return F.element_at(F.split(_col(path), "/"), -1)


def dest_path(path: Column | str, src_root: Column, dst_root: Column) -> Column:
    """dst_root / relative path, or dst_root / file name where path isn't below src_root."""
    p = _col(path)
    below = F.startswith(p, F.concat(src_root, F.lit("/")))
    return F.concat_ws("/", dst_root, F.when(below, rel_path(p, src_root)).otherwise(base_name(p)))


def components(path: Column | str) -> Column:
    return F.filter(F.split(_col(path), "/"), lambda x: ~x.isin("", "."))


def depth(path: Column | str) -> Column:
    return F.size(F.split(_col(path), "/"))


def ancestors(path: Column | str) -> Column:
    """All directories above path, below its root, shortest first; empty for top-level names."""
    parts = F.split(_col(path), "/")
    n = F.size(parts)
    none = F.array().cast("array<string>")
    return F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).otherwise(none)


def parent(path: Column | str) -> Column:
    """The directory that holds path; empty for top-level names."""
    return F.regexp_replace(_col(path), "(^|/)[^/]*$", "")


def parse_endpoint(text: Column | str, scheme: str = SCHEME) -> Column:
    """Struct (host, port, path) of a remote endpoint; null for anything else, which is local.

    ``scheme:[//]host[:port][/path]``, scheme in any case, port 1 to 65535."""
    t = F.regexp_replace(_col(text), r"(?U)^\s+|\s+$", "")  # any white space
    rest = F.regexp_extract(t, f"^(?i:{scheme}):(?://)?([^/]+)", 1)
    tail = F.regexp_extract(t, f"^(?i:{scheme}):(?://)?[^/]+((?s:/.*))$", 1)
    host = F.substring_index(rest, ":", 1)
    named = F.contains(rest, F.lit(":"))
    digits = F.substring(rest, F.length(host) + 2, F.length(rest))
    port = F.when(~named, F.lit(DEFAULT_PORT)).when(digits.rlike(r"^\+?0*[0-9]{1,9}$"), F.regexp_extract(digits, "^\\+?0*([0-9]+)$", 1).try_cast("int"))
    ok = (rest != "") & port.between(1, 65535)
    return F.when(
        ok, F.struct(host.alias("host"), port.cast("int").alias("port"), F.when(tail == "", "/").otherwise(tail).alias("path"))
    )


def format_endpoint(host: Column, port: Column, path: Column, scheme: str = SCHEME) -> Column:
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    return F.concat(F.lit(f"{scheme}://"), host, F.lit(":"), port.cast("string"), F.when(F.startswith(p, F.lit("/")), p).otherwise(F.concat(F.lit("/"), p)))


def path_key(path: Column | str, fold: bool = False) -> Column:
    """The join key of a path; folded, ASCII letters alone are lower-cased."""
    return F.translate(_col(path), _UPPER, _LOWER) if fold else _col(path)


def safe_path(path: Column | str, windows: bool = False) -> Column:
    """Struct (path, reason): the normalised path, or null and why it is rejected."""
    p = _col(path)
    parts = F.split(p, "/")
    reason = (
        F.when(F.contains(p, F.char(F.lit(0))), "nul")
        .when(F.startswith(p, F.lit("/")), "absolute")
        .when(F.exists(parts, lambda x: x == ".."), "parent")
    )
    if windows:
        reason = reason.when(p.rlike("^[A-Za-z]:"), "prefix").when(F.contains(p, F.lit(":")), "colon")
    return F.struct(F.when(reason.isNull(), F.array_join(components(p), "/")).alias("path"), reason.alias("reason"))


def clean_path(path: Column | str) -> Column:
    """Root, ``.``, ``..`` and empty components dropped without complaint."""
    return F.array_join(F.filter(F.split(_col(path), "/"), lambda x: ~x.isin("", ".", "..")), "/")


def is_under_root(real_path: Column, root: Column) -> Column:
    return (real_path == root) | F.startswith(real_path, F.concat(root, F.lit("/")))


def normalize_path(path: Column | str) -> Column:
    """``.`` and ``..`` resolved in the text; the input where ``..`` would leave the top."""
    p = _col(path)
    done = F.aggregate(
        components(p),
        F.struct(F.array().cast("array<string>").alias("a"), F.lit(True).alias("ok")),
        lambda acc, x: F.struct(
            F.when(x != "..", F.concat(acc["a"], F.array(x))).otherwise(F.slice(acc["a"], F.lit(1), F.greatest(F.size(acc["a"]) - 1, F.lit(0)))).alias("a"),
            (acc["ok"] & ((x != "..") | (F.size(acc["a"]) > 0))).alias("ok"),
        ),
        lambda acc: F.when(acc["ok"], F.array_join(acc["a"], "/")),
    )
    return F.coalesce(F.concat(F.when(F.startswith(p, F.lit("/")), "/").otherwise(""), done), p)


def two_decimals(value: Column) -> Column:
    """A number as text of two decimals, as C's printf rounds it: from its exact value, ties to the even digit."""
    return F.call_function("format_number", value, F.lit("0.00"))


def human_mb(size: Column | str) -> Column:
    return two_decimals(_col(size) / 1048576.0)


def human_gb(size: Column | str) -> Column:
    return two_decimals(_col(size) / 1073741824.0)


def mtime_sec(ts: Column | str) -> Column:
    """Whole epoch seconds; unknown or earlier ones are 0."""
    return F.greatest(F.coalesce(F.unix_seconds(_col(ts)), F.lit(0)), F.lit(0))
