"""The catalog's tables as projections of the driver's: the same SQL for Spark and for the checking engine.

A name in doubled angle brackets is a function that the two dialects spell differently. CAT( takes null as empty in both.
PLACE is where a row of the first table stands, which Spark must be told of where equal keys count in the table's order.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_DIALECTS = {
    "spark": {"K": "cast(get_json_object(props, '$.k') as bigint)", "SHA": "sha2({0}, 256)", "ADDMIN": "timestampadd(MINUTE, {1}, {0})", "ADDSEC": "timestampadd(SECOND, {1}, {0})", "TS": "timestamp_ntz'{0}'", "CAT": "concat_ws('', ", "PLACE": ", _place"},
    "duckdb": {"K": "cast(props->>'$.k' as bigint)", "SHA": "sha256({0})", "ADDMIN": "({0} + to_minutes(cast({1} as bigint)))", "ADDSEC": "({0} + to_seconds(cast({1} as bigint)))", "TS": "timestamp '{0}'", "CAT": "concat(", "PLACE": ""},
}
_DIALECTS["unplaced"] = _DIALECTS["spark"] | {"PLACE": ""}

#: name -> (driver tables, SQL)
_VIEWS = {
    "chat_logs": (
        ("events",),
        """select event_id as request_id, user_id, <<SHA|cast(user_id as string)>> as ip_address_hash,
        case event_type when 'error' then 'error' when 'signup' then 'rate_limited' else 'success' end as status,
        case when event_type = 'error' then case <<K>> % 3 when 0 then 'timeout' when 1 then 'connect_error' else 'internal' end end as error_type,
        value as response_time_ms, case when <<K>> % 5 = 0 then null else value / 4 end as first_token_time_ms,
        <<K>> as prompt_tokens, 2 * <<K>> as completion_tokens, 3 * <<K>> as total_tokens, cast(<<K>> as double) * 1e-4 as cost_usd,
        case when <<K>> % 2 = 0 then 'app_a' else 'app_b' end as app_id, ts as created_at from events""",
    ),
    "ai_logs": (
        ("lineitem", "part"),
        """select l_orderkey * 10 + l_linenumber as id,
        case when l_orderkey % 20 = 0 then <<CAT>>'feedback_', cast(l_orderkey as string)) else <<CAT>>'doc_', cast(l_orderkey as string)) end as processing_id,
        case when l_orderkey % 20 = 0 then 'FEEDBACK_ANALYSIS' else <<CAT>>'STEP_', l_returnflag, l_linestatus) end as step_name,
        case when l_partkey % 17 = 0 then null else p_brand end as model_name, <<CAT>>'provider_', cast(p_size % 3 as string)) as model_provider,
        cast(l_quantity * 100 as bigint) as input_tokens, cast(l_linenumber * 40 as bigint) as output_tokens, l_returnflag as document_type, l_shipdate as created_at<<PLACE>>
        from lineitem left join part on l_partkey = p_partkey""",
    ),
    "models": (
        ("part",),
        """select p_brand as name, case when p_brand like '%1' then null when p_brand like '%2' then cast(0 as double) else cast(max(p_size) as double) / 10 end as price_input,
        cast(max(p_size) as double) / 5 as price_output, max(p_size) % 2 = 0 as is_enabled from part group by p_brand""",
    ),
    "jobs": (
        ("orders",),
        """select o_orderkey as job_id, o_custkey as user_id, case o_orderstatus when 'F' then 'COMPLETED' when 'O' then 'RUNNING' else 'PENDING' end as status,
        o_orderdate as uploaded_at, <<ADDSEC|o_orderdate|o_custkey % 3000>> as started_at,
        case when o_orderstatus = 'F' then <<ADDSEC|o_orderdate|o_custkey % 3000 + 60>> end as completed_at,
        case when o_orderpriority like '1%' then true when o_orderpriority like '2%' then false when o_orderpriority like '4%' then null else o_orderkey % 2 = 0 end as data_consent_given,
        <<CAT>>'text of ', cast(o_orderkey as string)) as original_text, case when o_orderkey % 3 = 0 then null else <<CAT>>'simple ', cast(o_orderkey as string)) end as translated_text from orders""",
    ),
    "steps": (
        ("lineitem",),
        """select l_orderkey * 10 + l_linenumber as id, case when l_orderkey % 97 = 0 then null when l_orderkey % 50 = 0 then l_orderkey + 100000000 else l_orderkey end as job_id,
        l_linenumber as step_order, case l_linenumber when 1 then 'Text Extraction' when 2 then 'PII Removal' when 3 then 'Classification' else <<CAT>>'Step ', cast(l_linenumber as string)) end as step_name,
        case when l_linenumber = 6 then 'FAILED' when l_linestatus = 'F' then 'COMPLETED' else 'RUNNING' end as status,
        <<CAT>>'out ', cast(l_partkey as string)) as output_text, case when l_linenumber = 6 then <<CAT>>'error ', l_returnflag) end as error_message,
        l_quantity as execution_time_seconds, l_shipdate as started_at from lineitem""",
    ),
    "feedback": (
        ("labels", "documents"),
        """select d.doc_id as id, d.doc_id as processing_id, 1 + (d.doc_id * 7 + quality * 2 + toxic) % 5 as overall_rating,
        case when d.doc_id % 7 = 0 then null else quality = 1 end as data_consent_given,
        case d.doc_id % 4 when 0 then '' when 1 then null else <<CAT>>'comment ', cast(d.doc_id as string)) end as comment,
        <<CAT>>'{"clarity":', cast(d.doc_id % 6 as string), ',"speed":', cast(d.doc_id % 4 as string), '}') as detailed_ratings,
        case d.doc_id % 4 when 0 then 'PENDING' when 1 then 'FAILED' else 'COMPLETED' end as analysis_status,
        case when d.doc_id % 3 = 0 then null else cast(d.doc_id % 10 as double) end as quality_score,
        case when d.doc_id % 4 < 2 then null else 'summary' end as analysis_summary, <<ADDMIN|<<TS|2024-01-01 00:00:00>>|d.doc_id * 37>> as created_at
        from documents d join labels l on d.doc_id = l.doc_id""",
    ),
    "audit": (
        ("events",),
        """select event_id as id, user_id, <<CAT>>'10.0.', cast(user_id % 7 as string), '.', cast(user_id % 50 as string)) as ip_address,
        case event_type when 'error' then 'LOGIN_FAILED' when 'signup' then 'USER_CREATED' when 'purchase' then 'PIPELINE_UPDATED' when 'click' then 'PERMISSION_DENIED' else 'LOGIN' end as action,
        case when <<K>> % 4 = 0 then null else <<CAT>>'resource_', cast(<<K>> % 4 as string)) end as resource_type, cast(<<K>> as string) as resource_id,
        <<CAT>>'Detail ', cast(<<K>> as string)) as details, ts as created_at from events""",
    ),
    "users": (
        ("customer",),
        """select c_custkey as id, c_name as name, case c_mktsegment when 'BUILDING' then 'ADMIN' else 'USER' end as role, c_acctbal >= 0 as is_active,
        cast(floor(abs(c_acctbal)) as bigint) % 12 as failed_login_attempts from customer""",
    ),
    "api_keys": (
        ("customer",),
        """select c_custkey as id, c_nationkey as user_id, c_acctbal >= 0 as is_active, c_custkey % 11 = 0 as is_revoked,
        case when c_custkey % 5 = 0 then null else <<ADDMIN|<<TS|2024-01-01 00:00:00>>|c_custkey * 61 % 90000>> end as expires_at from customer""",
    ),
    "members": (
        ("customer",),
        """select c_custkey as id, c_custkey % 13 = 0 as banned_for_good,
        case when c_custkey % 3 = 0 then <<ADDMIN|<<TS|2024-01-01 00:00:00>>|c_custkey * 67 % 90000>> end as banned_until,
        case when c_custkey % 4 = 1 then <<ADDMIN|<<TS|2024-01-01 00:00:00>>|c_custkey * 71 % 90000>> end as locked_until from customer""",
    ),
    "step_defs": (
        ("part",),
        """select p_partkey as id, p_name as name, p_size as step_order, p_partkey % 3 <> 0 as enabled, case when p_partkey % 4 = 0 then null else p_partkey % 25 end as class_id,
        p_partkey % 4 = 0 and p_partkey % 40 = 0 as is_branching, p_partkey % 4 = 0 and p_partkey % 10 = 6 as post_branching,
        case p_partkey % 5 when 0 then null when 1 then '[]' when 2 then '["target_language"]' when 3 then '["target_language","document_type"]' else '["document_type"]' end as required_variables,
        <<CAT>>'Use {input_text} for ', case when p_partkey % 2 = 0 then '{target_language}' else p_brand end) as prompt_template from part""",
    ),
    "classes": (
        ("nation",),
        """select n_nationkey as id, upper(n_name) as class_key, n_regionkey <> 2 as is_enabled, n_nationkey % 6 = 0 as is_system,
        case when n_nationkey % 3 = 0 then '[]' when n_nationkey % 3 = 1 then null else '["letter","report"]' end as examples,
        case when n_nationkey % 4 = 0 then '[]' else <<CAT>>'["', lower(n_name), '","strong"]') end as strong_indicators,
        case when n_nationkey % 5 = 0 then null else '["weak"]' end as weak_indicators from nation""",
    ),
    "settings": (
        ("part",),
        """select <<CAT>>case when p_partkey % 5 = 0 then 'enable_' when p_partkey % 5 = 1 then 'enableX' else 'limit.' end, cast(p_partkey as string)) as key,
        case p_partkey % 6 when 0 then 'true' when 1 then 'False' when 2 then 'yes' when 3 then cast(p_size as string) when 4 then cast(p_retailprice as string) else p_type end as value,
        p_name as description from part""",
    ),
}


def spread(df: DataFrame) -> DataFrame:
    """A small table of few row groups dealt over all cores, for expressions that cost much more than a shuffle of its rows. A table with
    two input partitions per core or more stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= 2 * cores else df.repartition(2 * cores)


def sql(name: str, dialect: str) -> str:
    """A view's query in a dialect."""
    spelled, text = _DIALECTS[dialect], _VIEWS[name][1]
    while m := re.search(r"<<(\w+)(?:\|((?:(?!<<|>>).)*))?>>", text, re.S):
        text = text[: m.start()] + spelled[m[1]].format(*(m[2] or "").split("|")) + text[m.end() :]
    return text


def view(spark: SparkSession, sf_dir: str, name: str, place: bool = False) -> DataFrame:
    """A view as a DataFrame; scans read only the columns that a query keeps. With `place` it has `_place`, the table's order of rows."""
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in _VIEWS[name][0]}
    if place:
        first = _VIEWS[name][0][0]
        tables[first] = tables[first].select("*", F.struct("_metadata.file_path", "_metadata.row_index").alias("_place"))
    text = sql(name, "spark" if place else "unplaced").replace("{", "{{").replace("}", "}}")
    for t in tables:
        text = re.sub(rf"\b(from|join) {t}\b", rf"\1 {{{t}}}", text)
    return spark.sql(text, **tables)


def with_views(query: str, *names: str) -> str:
    """The checking engine's query over views."""
    return "WITH " + ", ".join(f"{n} AS ({sql(n, 'duckdb')})" for n in names) + "\n" + query
