"""Binary and textual formats as column expressions.

Unsigned 64-bit numbers are decimal(20,0) at the edge of a codec.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Flags of a versioned value (bit 0: tombstone) and entry type names.
NORMAL, TOMBSTONE, LOB, LOB_TOMBSTONE, LOB_FILE, LOB_FILE_TOMBSTONE = range(6)
OVERFLOW_BYTES, FILE_BYTES, PIECE_BYTES = 2048, 262144, 4024
# Labels of task states and priorities, from 0, and modules that run on a core of their own.
TASK_STATES = ("queued", "executing", "passed", "failed", "timeout", "busy", "retrying", "completed")
PRIORITIES = ("critical", "high", "urgent", "important", "normal-high", "normal", "normal-low", "low", "background", "idle")
PER_CORE = ("hlc", "wal", "transaction", "replication")


def be(n: Column, width: int) -> Column:
    """A number as big-endian bytes."""
    return F.unhex(F.lpad(F.hex(n), 2 * width, "0"))


def unbe(b: Column) -> Column:
    """Big-endian bytes as decimal(20,0)."""
    return F.conv(F.hex(b), 16, 10).cast("decimal(20,0)")


def is_tombstone(flag: Column) -> Column:
    return flag.bitwiseAND(1) == 1


def build_version(flag: Column, ts: Column, value: Column, prev_flag: Column, prev_ts: Column, prev_value: Column) -> Column:
    """[flag 1][prev flag 1][prev ts 8][prev length 2][prev][ts 8][value]; previous values over 65535 bytes are refused."""
    size = F.octet_length(prev_value)
    ok = F.when(size > 65535, F.raise_error(F.lit("previous value too long"))).when(ts == 0, F.raise_error(F.lit("timestamp 0"))).otherwise(F.lit(b""))
    return F.concat(ok, be(flag, 1), be(prev_flag, 1), be(prev_ts, 8), be(size, 2), prev_value, be(ts, 8), value)


def parse_version(b: Column) -> Column:
    """The fields of ``build_version``; null if too short or of an unknown flag."""
    n = unbe(F.substring(b, 11, 2)).cast("int")
    flag = unbe(F.substring(b, 1, 1)).cast("int")
    ok = (F.octet_length(b) >= 20) & (flag <= LOB_FILE_TOMBSTONE) & (F.octet_length(b) >= 20 + n)
    part = F.struct(
        flag.alias("flag"), unbe(F.substring(b, 2, 1)).cast("int").alias("prev_flag"), unbe(F.substring(b, 3, 8)).alias("prev_ts"),
        F.substring(b, F.lit(13), n).alias("prev_value"), unbe(F.substring(b, n + 13, F.lit(8))).alias("ts"), F.substring(b, n + 21, F.octet_length(b)).alias("value"),
    )
    return F.when(ok, part)


def tier(size: Column, overflow: int = OVERFLOW_BYTES, file: int = FILE_BYTES) -> Column:
    return F.when(size > file, "file").when(size > overflow, "overflow").otherwise("inline")


def pieces(b: Column, size: int = PIECE_BYTES) -> Column:
    """The pieces of a large value, in order; none for an empty one."""
    n = F.ceil(F.octet_length(b) / size).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(b, i * size + 1, F.lit(size)))).otherwise(F.array().cast("array<binary>"))


def put_together(cut, key: Column):
    """``key, n_pieces, b`` of values cut into ``i, piece``."""
    return cut.groupBy(key).agg(F.count("*").cast("int").alias("n_pieces"), F.expr("listagg(piece) within group (order by i)").alias("b"))


def child_pointer(page: Column, version: Column) -> Column:
    """[63:32] version, cut to 32 bits, [31:0] page."""
    low = F.lit(0xFFFFFFFF)
    return F.shiftleft(version.cast("bigint").bitwiseAND(low), 32).bitwiseOR(page.cast("bigint").bitwiseAND(low))


def child_parts(p: Column) -> tuple[Column, Column]:
    """Page and version."""
    return p.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(p, 32)


def valid_page(page: Column) -> Column:
    return page != F.lit(0xFFFFFFFF)


def chunk_position(chunk: Column, offset: Column, kind: Column) -> Column:
    """[63:38] chunk, [37:6] offset, [5:1] kind, [0] zero."""
    return F.shiftleft(chunk.cast("bigint"), 38).bitwiseOR(F.shiftleft(offset.cast("bigint"), 6)).bitwiseOR(F.shiftleft(kind.cast("bigint"), 1))


def position_parts(p: Column) -> Column:
    return F.struct(F.shiftrightunsigned(p, 38).alias("chunk"), F.shiftrightunsigned(p, 6).bitwiseAND(0xFFFFFFFF).alias("offset"), F.shiftrightunsigned(p, 1).bitwiseAND(31).alias("kind"))


def fnv1a32(text: Column) -> Column:
    """FNV-1a of a value's bytes."""
    h = F.hex(text.cast("binary"))
    bits = F.transform(F.sequence(F.lit(1), F.length(h), F.lit(2)), lambda i: F.conv(F.substring(h, i, F.lit(2)), 16, 10).cast("bigint"))
    run = F.aggregate(bits, F.lit(2166136261).cast("bigint"), lambda a, x: (a.bitwiseXOR(x) * 16777619).bitwiseAND(4294967295))
    return F.when(F.length(h) == 0, F.lit(2166136261).cast("bigint")).otherwise(run)


def hlc_pack(pt: Column, c: Column) -> Column:
    return F.shiftleft(pt.cast("bigint"), 16).bitwiseOR(c.cast("bigint"))


def hlc_update(now: Column, pt: Column, c: Column, remote_pt: Column, remote_c: Column) -> Column:
    """Merge with a remote clock: the counter moves on only if all physical parts tie, and is else 0."""
    top = F.greatest(now, pt, remote_pt)
    tie = (now == pt) & (pt == remote_pt)
    return F.struct(top.alias("pt"), F.when(tie, F.greatest(c, remote_c) + 1).otherwise(0).alias("c"))


def hlc_update_standard(now: Column, pt: Column, c: Column, remote_pt: Column, remote_c: Column) -> Column:
    """The published hybrid-clock rule, monotonic in every case."""
    top = F.greatest(now, pt, remote_pt)
    n = F.when((top == pt) & (top == remote_pt), F.greatest(c, remote_c) + 1).when(top == pt, c + 1).when(top == remote_pt, remote_c + 1).otherwise(0)
    return F.struct(top.alias("pt"), n.alias("c"))


def hlc_compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1 for two structs of (pt, c)."""
    return F.when(a < b, -1).when(a == b, 0).otherwise(1)


def request_id(node: Column, second: Column, seq: Column) -> Column:
    return F.format_string("%s-%08x-%04x", node, second, seq)


def request_parts(rid: Column) -> Column:
    """Node, second and sequence; null unless there are exactly four dash parts."""
    p = F.split(rid, "-")
    num = lambda i: F.conv(F.get(p, F.lit(i)), 16, 10).cast("bigint")
    return F.when(F.size(p) == 4, F.struct(F.concat_ws("-", F.get(p, F.lit(0)), F.get(p, F.lit(1))).alias("node"), num(2).alias("second"), num(3).alias("seq")))


def request_getters(rid: Column) -> tuple[Column, Column, Column]:
    """Node, second and sequence as far as they can be read: '' and 0 where a part is missing or no number that fits."""
    p = F.split(rid, "-")
    n = F.size(p)
    num = lambda i, fits: F.when(F.try_element_at(p, F.lit(i)).rlike(fits), F.conv(F.try_element_at(p, F.lit(i)), 16, 10).cast("bigint")).otherwise(0)
    node = F.when(n >= 3, F.concat_ws("-", F.slice(p, F.lit(1), F.greatest(n - 2, F.lit(0))))).otherwise("")
    second = F.when(n >= 3, num(-2, "^0*[0-7]?[0-9a-fA-F]{1,15}$")).otherwise(0)
    return node, second, F.when(n >= 4, num(-1, "^0*[0-9a-fA-F]{1,8}$")).otherwise(0)


def source_parts(source: Column) -> Column:
    """Module, sub-module and action, trimmed; null unless there are three and none is empty."""
    p = F.transform(F.split(source, ":"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    part = F.struct(*(F.get(p, F.lit(i)).alias(x) for i, x in enumerate(("module", "sub_module", "action"))))
    return F.when((F.size(p) == 3) & ~F.array_contains(p, ""), part)


def source_mode(module: Column) -> Column:
    """Where a module's tasks run: those that wait for nothing on a core, the others in a pool."""
    return F.when(module.isin(*PER_CORE), "per-core").otherwise("pool")


def label(code: Column, names: tuple[str, ...], other: str = "unknown") -> Column:
    return F.coalesce(F.get(F.array(*map(F.lit, names)), code.cast("int")), F.lit(other))


def prepare_record(key: Column, op: Column, old_flag: Column, old_ts: Column, old: Column, new: Column) -> Column:
    """[key length 4][key][op 1][old flag 1][old ts 8][old length 4][old][new flag 1][new length 4][new]; op 2 deletes."""
    new_flag = F.when(op == 2, TOMBSTONE).otherwise(NORMAL)
    return F.concat(be(F.octet_length(key), 4), key, be(op, 1), be(old_flag, 1), be(old_ts, 8), be(F.octet_length(old), 4), old, be(new_flag, 1), be(F.octet_length(new), 4), new)


def source_matches(source: Column, pattern: str) -> Column:
    """Whether a three-part source id matches a pattern whose parts may be '*'."""
    got, ok = F.split(source, ":"), F.lit(True)
    for i, part in enumerate(pattern.split(":")):
        if part != "*":
            ok = ok & (F.get(got, F.lit(i)) == part)
    return (F.size(got) == 3) & ok


def backoff_us(retry: Column) -> Column:
    """2 ** (retry - 16) microseconds, at least 1 and at most 1000."""
    return F.least(F.pow(F.lit(2.0), F.greatest(retry - 16, F.lit(0))), F.lit(1000.0))


def header_map(text: Column) -> Column:
    """A 'key:value' line header as a map."""
    return F.str_to_map(text, F.lit("\n"), F.lit(":"))
