"""Platform views: what the engine's operators run over, mapped from the driver's tables.

Timestamps are instants in epoch milliseconds (``*_ms``): sub-millisecond parts are floored, and no
view depends on the session's time zone.
"""

from __future__ import annotations

from enum import StrEnum

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BASE_MS = 1704067200000  # 2024-01-01T00:00:00Z
DAY_MS = 86_400_000


class Scope(StrEnum):
    """Views a session may read. The sealed labels are deliberately not among them."""

    ACCOUNT_META = "account_meta"
    CHANNEL = "channel"
    VIDEO = "video"
    COMMENT = "comment"
    ENGAGEMENT_EVENT = "engagement_event"
    INFRA_HINT = "infra_hint"


#: Columns only the sealed labels have; no exported view may carry one.
SEALED_COLUMNS = {"threat_class", "ring_id", "planted_ts", "generator_params_hash"}

#: What of a line gives a comment's ids.
_LINE = {"comment_id": "concat_ws('_', 'cmt', l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(l_shipdate AS date))", "video_id": "concat('vid_', l_partkey)"}
_VIEWS = {
    "account_meta": """
        SELECT concat('acct_', c_custkey) account_id, concat('ipb_', c_custkey % 40) signup_ip_bucket,
               CASE WHEN c_custkey % 20 = 0 THEN concat('dev_', c_nationkey) END device_fingerprint_hint,
               c_acctbal > 9000 is_verified, c_name display_name, {base} + (c_custkey % 365) * {day} created_ms
        FROM {customer}""",
    "channel": """
        SELECT concat('chan_', s_suppkey) channel_id, concat('acct_', s_suppkey) account_id, s_name display_name,
               concat('about ', s_name) description FROM {supplier}""",
    "video": """
        SELECT concat('vid_', p_partkey) video_id, concat('chan_', p_partkey % (SELECT count(*) FROM {supplier})) channel_id,
               p_name title, p_size % 2 = 0 synthetic_media_disclosed,
               CASE p_size % 3 WHEN 0 THEN 'present' WHEN 1 THEN 'unknown' ELSE 'absent' END provenance_signal,
               {base} + (p_partkey % 720) * 3600000 published_ms, p_size * 10 duration_s
        FROM {part}""",
    "comment": f"""
        SELECT {_LINE["comment_id"]} comment_id,
               {_LINE["video_id"]} video_id, concat('acct_', o_custkey) account_id,
               unix_millis(cast(l_shipdate AS timestamp)) posted_ms,
               CASE WHEN l_returnflag = 'R' AND l_discount >= 0.095 THEN concat('tmpl_', l_suppkey % 7) END template_id,
               concat('status ', l_returnflag, l_linestatus) text
        FROM {{lineitem}} JOIN {{orders}} ON l_orderkey = o_orderkey""",
    "engagement_event": """
        SELECT concat('ev_', event_id) event_id, concat('acct_', user_id) account_id,
               CASE event_type WHEN 'click' THEN 'like' WHEN 'signup' THEN 'subscribe' WHEN 'purchase' THEN 'share'
                    WHEN 'error' THEN 'report' ELSE event_type END kind,
               CASE WHEN event_type <> 'signup' THEN concat('vid_', (event_id * 7919) % (SELECT count(*) FROM {part})) END video_id,
               CASE WHEN event_type = 'signup' THEN concat('chan_', event_id % (SELECT count(*) FROM {supplier})) END channel_id,
               unix_millis(cast(ts AS timestamp)) ts_ms
        FROM {events}""",
    "infra_hint": """
        SELECT concat('hint_ip_', c_custkey) hint_id, 'account' subject_kind, concat('acct_', c_custkey) subject_id,
               'shared_ip_bucket' signal_type, concat('nat_', c_nationkey) signal_value,
               {base} + (c_custkey % 30) * {day} observed_ms
        FROM {customer}
        UNION ALL
        SELECT concat('hint_dev_', c_custkey), 'account', concat('acct_', c_custkey), 'shared_device',
               concat('dev_', c_custkey % 10), {base} + (c_custkey % 13) * {day}
        FROM {customer}
        UNION ALL
        SELECT concat('hint_up_', s_suppkey), 'channel', concat('chan_', s_suppkey), 'shared_upload_pattern',
               concat('up_', s_nationkey), {base} + (s_suppkey % 5) * {day}
        FROM {supplier}""",
}
_SEALED = """
    SELECT 'video' entity_kind, concat('vid_', p_partkey) entity_id,
           CASE WHEN toxic = 1 AND quality = 1 THEN 't07' WHEN toxic = 1 THEN 't01' ELSE 'benign' END threat_class,
           CASE WHEN toxic = 1 THEN concat('ring_', doc_id % 10) END ring_id
    FROM {part} LEFT JOIN {labels} ON doc_id = p_partkey
    UNION ALL
    SELECT 'comment', comment_id, CASE WHEN template_id IS NOT NULL THEN 't01' ELSE 'benign' END,
           concat('ring_', template_id) FROM {comment}"""
_TABLES = {
    "account_meta": ["customer"],
    "channel": ["supplier"],
    "video": ["part", "supplier"],
    "comment": ["lineitem", "orders"],
    "engagement_event": ["events", "part", "supplier"],
    "infra_hint": ["customer", "supplier"],
}


#: Large tables that a view joins, and the keys it joins them by.
_KEYS = {"comment": {"lineitem": "l_orderkey", "orders": "o_orderkey"}}
#: Fixed value: how many times the session's shuffle partitions a dealt view is joined in.
FINER = 4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, scope: Scope | str, dealt: bool = False, among: DataFrame | None = None) -> DataFrame:
    """One scope as a DataFrame; an unknown name is refused, never guessed.

    ``dealt``: its large tables meet in ``FINER`` times the session's shuffle partitions, so a task sorts so much less of them.
    ``among``: only the comments with this one column's ids; lines are cut down to them before they meet orders.
    """
    name = Scope(scope).value
    text = _VIEWS[name].replace("{base}", f"{BASE_MS}L").replace("{day}", f"{DAY_MS}L")
    tables = {t: table(spark, sf_dir, t) for t in _TABLES[name]}
    if dealt:
        n = FINER * int(spark.conf.get("spark.sql.shuffle.partitions"))
        tables |= {t: tables[t].repartition(n, key) for t, key in _KEYS.get(name, {}).items()}
    if among is not None:
        lines, (column,) = tables["lineitem"], among.columns
        tables["lineitem"] = lines.withColumn("_id", F.expr(_LINE[column])).join(among.select(F.col(column).alias("_id")), "_id", "left_semi").select(*lines.columns)
    return spark.sql(text, **tables)


def sealed_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ground truth of videos and comments: for measurement and evaluation only."""
    return spark.sql(_SEALED, part=table(spark, sf_dir, "part"), labels=table(spark, sf_dir, "labels"), comment=view(spark, sf_dir, Scope.COMMENT))


class Platform:
    """The views of one dataset, made when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name == "labels":
            return sealed_labels(self.spark, self.sf_dir)
        try:
            return view(self.spark, self.sf_dir, name)
        except ValueError as e:
            raise AttributeError(name) from e

    def dealt(self, name: str) -> DataFrame:
        return view(self.spark, self.sf_dir, name, dealt=True)

    def comments_among(self, ids: DataFrame) -> DataFrame:
        """The comments with these ``video_id`` or ``comment_id`` (the one column of ``ids``)."""
        return view(self.spark, self.sf_dir, Scope.COMMENT, among=ids)

    def raw(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)
