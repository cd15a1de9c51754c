"""The data model, derived from the driver tables; each table has a Spark and a SQL form.

`TABLES[name](spark, folder)` gives the DataFrame; `with_tables(sql, ...)` puts the same
definitions in front of a DuckDB query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from reelgrid.operators.scan import row_number, running_sum, scan, time_chunk
from reelgrid.sources.tables import read_table, read_texts

MS_PER_CHAR = 60
DAY = 86_400


def _epoch(ts: str) -> Column:
    """Whole seconds since 1970 of a timestamp without zone, whatever the session zone is."""
    return F.timestamp_diff("SECOND", F.expr("timestamp_ntz'1970-01-01'"), F.col(ts))


def _k() -> Column:
    return F.get_json_object("props", "$.k").cast("bigint")


def _line_id() -> Column:
    """A unique number per line item: order and line number repeat, so other columns are mixed in."""
    mix = (F.col("l_suppkey") * 7919 + F.col("l_partkey") * 104_729 + F.floor("l_quantity") * 1_299_709
           + F.floor("l_extendedprice")) % 10_000_019
    return (F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 10_000_019 + mix


def sentences(spark: SparkSession, folder: str) -> DataFrame:
    """Turns of a conversation spoken one after the other at a fixed pace."""
    t = read_table(spark, folder, "conversations").select(
        F.col("conv_id").alias("video_id"), F.col("turn").alias("idx"), "role", "text",
        (F.length("text") * MS_PER_CHAR).cast("long").alias("len"))
    seen = scan(t, ["video_id"], ["idx"], time_chunk("idx", 512),
                start_ms=running_sum(F.col("len"), False))
    return seen.select("video_id", "idx", "role", "text", F.col("start_ms"),
                       (F.col("start_ms") + F.col("len")).alias("end_ms"))


def doc_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Non-blank lines of a document on the same clock; offsets are summed inside the row."""
    lines = F.split("text", "\n")
    ends = F.aggregate(lines, F.array(F.lit(0).cast("long")), lambda acc, x: F.concat(
        acc, F.array(F.element_at(acc, -1) + (F.length(x) * MS_PER_CHAR).cast("long"))))
    d = (read_texts(spark, folder, "documents")
         .select(F.col("doc_id").alias("video_id"), F.col("source").alias("channel"), "lang",
                 lines.alias("lines"), ends.alias("ends"))
         .select("video_id", "channel", "lang", "ends", F.posexplode("lines").alias("idx", "text")))
    return (d.filter(F.trim("text") != "")
            .select("video_id", "channel", "lang", F.col("idx").cast("long").alias("idx"), "text",
                    F.element_at("ends", F.col("idx") + 1).alias("start_ms"),
                    F.element_at("ends", F.col("idx") + 2).alias("end_ms")))


def words(spark: SparkSession, folder: str) -> DataFrame:
    """Words of the sentences, spread evenly over their sentence."""
    s = sentences(spark, folder)
    w = F.filter(F.split("text", "\\s+"), lambda x: x != "")
    step = F.floor((F.col("end_ms") - F.col("start_ms")) / F.col("n"))
    return (s.select("video_id", "idx", "start_ms", "end_ms", w.alias("w"), F.size(w).alias("n"))
            .select("video_id", "idx", step.alias("step"), F.col("start_ms").alias("s0"),
                    F.posexplode("w").alias("pos", "word"))
            .select("video_id", F.col("idx").alias("turn"), "pos", (F.col("idx") * 100_000 + F.col("pos")).alias("word_id"), "word",
                    (F.col("s0") + F.col("pos") * F.col("step")).alias("start_ms"),
                    (F.col("s0") + (F.col("pos") + 1) * F.col("step")).alias("end_ms")))


def segments(spark: SparkSession, folder: str) -> DataFrame:
    """Clip segments: a supplier is a video, an order a clip, a day one second."""
    day = F.datediff(F.to_date("l_shipdate"), F.lit("1990-01-01").cast("date")).cast("long")
    return read_table(spark, folder, "lineitem").select(
        F.col("l_suppkey").alias("video_id"), F.col("l_orderkey").alias("order_id"),
        _line_id().alias("clip_id"),
        F.col("l_linenumber").cast("long").alias("seg_idx"),
        (day * 1000).alias("s_ms"),
        (day * 1000 + F.col("l_quantity").cast("long") * 1000).alias("e_ms"),
        (F.floor("l_extendedprice") % 101).alias("score"),
        F.when(F.col("l_returnflag") == "A", "exported").when(F.col("l_returnflag") == "R", "archived")
        .otherwise("suggested").alias("status"))


def signal(spark: SparkSession, folder: str) -> DataFrame:
    """Per-second loudness (hundredths) and motion (percent) of each user's event series."""
    e = read_table(spark, folder, "events").select(
        F.col("user_id").alias("video_id"), _epoch("ts").alias("at"), "ts", "event_id",
        F.round(F.col("value") * 100).cast("long").alias("rms"), _k().alias("motion"))
    seen = scan(e, ["video_id"], ["ts", "event_id"], time_chunk("at", 7 * DAY), n=row_number())
    return seen.select("video_id", (F.col("n") - 1).alias("sec"), "rms", "motion")


def jobs(spark: SparkSession, folder: str) -> DataFrame:
    """Job rows out of the event stream; times are epoch seconds."""
    k, ts = F.col("k"), _epoch("ts")
    e = read_table(spark, folder, "events").withColumn("k", _k())
    status = (F.when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "error", "failed")
              .when(F.col("event_type") == "click", "running").when(F.col("event_type") == "view", "pending")
              .when(k % 2 == 0, "canceled").otherwise("skipped"))
    kind = F.when(k % 3 == 0, "analyze").when(k % 3 == 1, "export").otherwise("auto")
    error = (F.when(k % 8 == 0, "HTTP 401 invalid api key")
             .when(k % 8 == 1, "429 rate limit: tokens per day, try again in 7m30.5s")
             .when(k % 8 == 2, "429 requests per minute reached, try again in 12s")
             .when(k % 8 == 3, "rate limit, retry-after: 45")
             .when(k % 8 == 4, "413 request too large for model")
             .when(k % 8 == 5, "organization has been restricted")
             .when(k % 8 == 6, "503 service unavailable").otherwise("disk full"))
    return e.select(
        F.col("event_id").alias("job_id"), F.col("user_id").alias("channel_id"),
        (F.col("user_id") * 100 + k).alias("video_id"), kind.alias("type"), status.alias("status"),
        ts.alias("created_at"),
        F.when(status.isin("done", "failed", "running"), ts + k * 13).alias("started_at"),
        F.when(status.isin("done", "failed"), ts + k * 13 + F.floor("value").cast("long")).alias("finished_at"),
        (k % 4).alias("attempts"), (k % 7).alias("priority"), (k % 5 == 0).alias("cancel_req"),
        F.when(F.col("event_type") == "error", error).alias("error"))


def channels(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("c_custkey")
    return read_table(spark, folder, "customer").select(
        k.alias("channel_id"), F.col("c_name").alias("name"),
        F.when(k % 11 == 0, "").otherwise(F.col("c_mktsegment")).alias("grp"),
        (F.col("c_acctbal") > 0).alias("pipe_on"), (k % 10 == 0).alias("pipe_hidden"),
        F.when(k % 4 == 0, F.lit(None).cast("string")).when(k % 4 == 1, " Fast cut ")
        .when(k % 4 == 2, "Story").otherwise("gone").alias("tpl_name"),
        (k % 4).alias("daily"), F.col("c_nationkey").cast("long").alias("nation_id"))


def ledger(spark: SparkSession, folder: str) -> DataFrame:
    """Intake ledger: one row per order; the hash repeats inside a channel."""
    o = read_table(spark, folder, "orders")
    k, at = F.col("o_orderkey"), _epoch("o_orderdate")
    status = (F.when(k % 9 == 0, "dup").when(k % 9 == 1, "bad").when(F.col("o_orderstatus") == "F", "done")
              .when(F.col("o_orderstatus") == "O", "taken").otherwise("error"))
    return o.select(
        k.alias("ledger_id"), F.col("o_custkey").alias("channel_id"),
        F.concat(F.lit("h"), (F.floor("o_totalprice") % 23).cast("string")).alias("file_hash"),
        F.concat(F.lit("file "), k.cast("string"), F.lit(".mp4")).alias("file_name"),
        status.alias("status"), k.alias("video_id"), F.col("o_orderpriority").alias("note"),
        (at + (k % 24) * 3600).alias("taken_at"),
        F.when(status != "taken", at + (k % 24) * 3600 + (k % 5) * 43_200).alias("done_at"))


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """File listing: one file per line item."""
    i, k = F.col("l_linenumber"), F.col("l_orderkey")
    stem = (F.when(k % 6 == 0, F.concat(F.lit("Part "), i.cast("string")))
            .otherwise(F.concat(F.lit("My clip "), F.col("l_partkey").cast("string"), F.lit(" [abc_"),
                                k.cast("string"), F.lit("] 720p - YouTube"))))
    ext = (F.when(i == 1, ".mp4").when(i == 2, ".MKV").when(i == 3, ".mp4.part")
           .when(i == 4, ".f137.mp4").when(i == 5, ".mp4").when(i == 6, ".txt").otherwise(".webm"))
    return read_table(spark, folder, "lineitem").select(
        F.col("l_suppkey").alias("channel_id"), _line_id().alias("file_id"),
        F.concat(stem, ext).alias("name"),
        F.concat(F.lit("/bin/"), F.date_format("l_shipdate", "yyyy-MM-dd"), F.lit("/"),
                 F.col("l_suppkey").cast("string"), F.lit("/"), stem, ext).alias("path"),
        F.when(F.col("l_quantity") < 3, 0).otherwise(F.floor("l_extendedprice")).cast("long").alias("size"),
        _epoch("l_shipdate").alias("mtime"),
        F.concat(F.lit("h"), (F.floor("l_extendedprice") % 23).cast("string")).alias("file_hash"))


def votes(spark: SparkSession, folder: str) -> DataFrame:
    return (read_table(spark, folder, "labels").join(
        read_table(spark, folder, "documents").select("doc_id", "source"), "doc_id")
        .select(F.col("doc_id").alias("vote_id"), F.col("doc_id").alias("clip_id"),
                F.col("source").alias("channel"),
                F.when(F.col("quality") == 1, 1).otherwise(-1).cast("long").alias("vote")))


def calls(spark: SparkSession, folder: str) -> DataFrame:
    """Service call log."""
    k = _k()
    return read_table(spark, folder, "events").select(
        F.col("event_id").alias("call_id"), (F.col("user_id") % 12).alias("key_id"),
        F.concat(F.lit("model"), (k % 3).cast("string")).alias("model"),
        (F.col("user_id") * 100 + k).alias("video_id"), _epoch("ts").alias("at"),
        F.floor(F.col("value") * 100).cast("long").alias("tok_in"), (k * 7).alias("tok_out"),
        (F.col("event_type") != "error").alias("ok"),
        F.when(F.col("event_type") == "error", F.when(k % 8 == 0, "HTTP 401 invalid api key")
               .when(k % 8 == 1, "429 rate limit: tokens per day, try again in 7m30.5s")
               .when(k % 8 == 2, "429 requests per minute reached, try again in 12s")
               .otherwise("503 service unavailable")).alias("error"))


TABLES = {f.__name__: f for f in (sentences, doc_lines, words, segments, signal, jobs, channels,
                                  ledger, listing, votes, calls)}

_JSON_K = "cast(json_extract_string(props, '$.k') as bigint)"
_SQL = {
    "sentences": ("""select video_id, idx, role, text, start_ms, start_ms + len as end_ms from (
        select conv_id as video_id, turn as idx, role, text, cast(length(text) * 60 as bigint) as len,
        cast(coalesce(sum(length(text) * 60) over (partition by conv_id order by turn
          rows between unbounded preceding and 1 preceding), 0) as bigint) as start_ms
        from conversations)""", ()),
    "doc_lines": ("""select doc_id as video_id, source as channel, lang, cast(idx - 1 as bigint) as idx,
        line as text, cast(coalesce(before, 0) as bigint) as start_ms,
        cast(coalesce(before, 0) + length(line) * 60 as bigint) as end_ms from (
        select *, sum(length(line) * 60) over (partition by doc_id order by idx
          rows between unbounded preceding and 1 preceding) as before from (
        select doc_id, source, lang, unnest(string_split(text, chr(10))) as line,
          generate_subscripts(string_split(text, chr(10)), 1) as idx from documents))
        where trim(line) <> ''""", ()),
    "words": ("""select video_id, idx as turn, cast(pos - 1 as integer) as pos, cast(idx * 100000 + pos - 1 as bigint) as word_id, word,
        cast(s0 + (pos - 1) * step as bigint) as start_ms, cast(s0 + pos * step as bigint) as end_ms from (
        select video_id, idx, start_ms as s0, (end_ms - start_ms) // len(w) as step,
          unnest(w) as word, generate_subscripts(w, 1) as pos from (
        select *, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') as w from sentences))""",
              ("sentences",)),
    "segments": ("""select l_suppkey as video_id, l_orderkey as order_id, (l_orderkey * 10 + l_linenumber) * 10000019 + (l_suppkey * 7919 + l_partkey * 104729 + cast(floor(l_quantity) as bigint) * 1299709 + cast(floor(l_extendedprice) as bigint)) % 10000019 as clip_id,
        cast(l_linenumber as bigint) as seg_idx,
        date_diff('day', date '1990-01-01', cast(l_shipdate as date)) * 1000 as s_ms,
        date_diff('day', date '1990-01-01', cast(l_shipdate as date)) * 1000 + cast(l_quantity as bigint) * 1000 as e_ms,
        cast(floor(l_extendedprice) as bigint) % 101 as score,
        case l_returnflag when 'A' then 'exported' when 'R' then 'archived' else 'suggested' end as status
        from lineitem""", ()),
    "signal": (f"""select user_id as video_id, cast(row_number() over (partition by user_id order by ts, event_id) - 1 as bigint) as sec,
        cast(round(value * 100) as bigint) as rms, {_JSON_K} as motion from events""", ()),
    "jobs": (f"""select job_id, channel_id, channel_id * 100 + k as video_id,
        case when k % 3 = 0 then 'analyze' when k % 3 = 1 then 'export' else 'auto' end as type, status, created_at,
        case when status in ('done','failed','running') then created_at + k * 13 end as started_at,
        case when status in ('done','failed') then created_at + k * 13 + cast(floor(value) as bigint) end as finished_at,
        k % 4 as attempts, k % 7 as priority, k % 5 = 0 as cancel_req,
        case when status = 'failed' then case k % 8 when 0 then 'HTTP 401 invalid api key'
          when 1 then '429 rate limit: tokens per day, try again in 7m30.5s'
          when 2 then '429 requests per minute reached, try again in 12s'
          when 3 then 'rate limit, retry-after: 45' when 4 then '413 request too large for model'
          when 5 then 'organization has been restricted' when 6 then '503 service unavailable'
          else 'disk full' end end as error
        from (select event_id as job_id, user_id as channel_id, {_JSON_K} as k, value,
          cast(floor(epoch(ts)) as bigint) as created_at,
          case event_type when 'purchase' then 'done' when 'error' then 'failed' when 'click' then 'running'
            when 'view' then 'pending' else case when {_JSON_K} % 2 = 0 then 'canceled' else 'skipped' end end as status
          from events)""", ()),
    "channels": ("""select c_custkey as channel_id, c_name as name,
        case when c_custkey % 11 = 0 then '' else c_mktsegment end as grp, c_acctbal > 0 as pipe_on,
        c_custkey % 10 = 0 as pipe_hidden,
        case c_custkey % 4 when 0 then null when 1 then ' Fast cut ' when 2 then 'Story' else 'gone' end as tpl_name,
        c_custkey % 4 as daily, cast(c_nationkey as bigint) as nation_id from customer""", ()),
    "ledger": ("""select ledger_id, channel_id, file_hash, file_name, status, ledger_id as video_id, note, taken_at,
        case when status <> 'taken' then taken_at + (ledger_id % 5) * 43200 end as done_at from (
        select o_orderkey as ledger_id, o_custkey as channel_id,
        'h' || cast(cast(floor(o_totalprice) as bigint) % 23 as varchar) as file_hash,
        'file ' || o_orderkey || '.mp4' as file_name,
        case when o_orderkey % 9 = 0 then 'dup' when o_orderkey % 9 = 1 then 'bad' when o_orderstatus = 'F' then 'done'
          when o_orderstatus = 'O' then 'taken' else 'error' end as status, o_orderpriority as note,
        cast(epoch(o_orderdate) as bigint) + (o_orderkey % 24) * 3600 as taken_at from orders)""", ()),
    "listing": ("""select channel_id, file_id, stem || ext as name,
        '/bin/' || strftime(l_shipdate, '%Y-%m-%d') || '/' || channel_id || '/' || stem || ext as path, size, mtime, file_hash
        from (select l_suppkey as channel_id, (l_orderkey * 10 + l_linenumber) * 10000019 + (l_suppkey * 7919 + l_partkey * 104729 + cast(floor(l_quantity) as bigint) * 1299709 + cast(floor(l_extendedprice) as bigint)) % 10000019 as file_id, l_shipdate,
        case when l_orderkey % 6 = 0 then 'Part ' || l_linenumber
          else 'My clip ' || l_partkey || ' [abc_' || l_orderkey || '] 720p - YouTube' end as stem,
        case l_linenumber when 1 then '.mp4' when 2 then '.MKV' when 3 then '.mp4.part' when 4 then '.f137.mp4'
          when 5 then '.mp4' when 6 then '.txt' else '.webm' end as ext,
        case when l_quantity < 3 then 0 else cast(floor(l_extendedprice) as bigint) end as size,
        cast(epoch(l_shipdate) as bigint) as mtime,
        'h' || cast(cast(floor(l_extendedprice) as bigint) % 23 as varchar) as file_hash from lineitem)""", ()),
    "votes": ("""select l.doc_id as vote_id, l.doc_id as clip_id, d.source as channel,
        cast(case when l.quality = 1 then 1 else -1 end as bigint) as vote
        from labels l join documents d using (doc_id)""", ()),
    "calls": (f"""select event_id as call_id, user_id % 12 as key_id, 'model' || ({_JSON_K} % 3) as model,
        user_id * 100 + {_JSON_K} as video_id, cast(floor(epoch(ts)) as bigint) as at,
        cast(floor(value * 100) as bigint) as tok_in, {_JSON_K} * 7 as tok_out, event_type <> 'error' as ok,
        case when event_type = 'error' then case {_JSON_K} % 8 when 0 then 'HTTP 401 invalid api key'
          when 1 then '429 rate limit: tokens per day, try again in 7m30.5s'
          when 2 then '429 requests per minute reached, try again in 12s'
          else '503 service unavailable' end end as error from events""", ()),
}


def with_tables(body: str, *names: str, more: dict[str, str] | None = None) -> str:
    """`body` after the definitions of the named tables and of extra ones in `more`."""
    parts: dict[str, str] = {}

    def add(name: str) -> None:
        sql, needs = _SQL[name]
        for n in needs:
            add(n)
        parts.setdefault(name, sql)

    for n in names:
        add(n)
    parts.update(more or {})
    heads = ",\n".join(f"{n} as materialized ({sql})" for n, sql in parts.items())
    return f"with recursive {heads}\n{body}" if heads else body
