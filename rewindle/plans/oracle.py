"""The registered queries in SQL, for checking results against an independent engine."""

from __future__ import annotations

LOG = """(SELECT *,
    CASE WHEN event_type = 'error' THEN 'delete' WHEN event_type = 'signup' THEN 'insert'
         ELSE 'update_postimage' END AS _change_type,
    CAST(day(ts) AS BIGINT) AS _commit_version, ts AS _commit_timestamp FROM events)"""

EVENT = "event_id, ts, user_id, event_type, value, props"


def _state(version: int) -> str:
    """Users as of a version."""
    return f"""(SELECT {EVENT} FROM (SELECT *, row_number() OVER (PARTITION BY user_id
        ORDER BY _commit_version DESC, event_id DESC) AS rn FROM {LOG}
        WHERE _commit_version <= {version}) WHERE rn = 1 AND _change_type <> 'delete')"""


HISTORY = f"""SELECT {EVENT}, ts AS __START_AT,
    lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS __END_AT FROM events"""

_CONTRACT = """o_orderkey AS CONTRACT_ID, o_orderpriority AS CNTRCT_SHRT_NME,
    CASE o_orderstatus WHEN 'F' THEN 'B1' WHEN 'O' THEN 'B2' END AS CONTRACT_BRAND_CDE,
    nullif(o_orderpriority, '5-LOW') AS CONTRACT_TYPE_CDE, CAST(o_orderdate AS DATE) AS OPEN_DTE,
    CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderdate AS DATE) + 30 END AS CLOSE_DTE,
    o_orderdate AS EXTRACT_DTTM"""

CONTRACTS = f"(SELECT {_CONTRACT} FROM orders)"

LOANS = """(SELECT l_orderkey AS LOAN_ID, l_orderkey AS CONTRACT_ID,
    l_returnflag AS LOAN_TYPE_CDE,
    CASE WHEN l_linestatus = 'O' THEN 'O1' ELSE 'C1' END AS LOAN_STATUS_CDE,
    CAST(l_extendedprice AS DECIMAL(22,6)) AS VALUE, l_shipdate AS EXTRACT_DTTM,
    l_linenumber, l_partkey, l_suppkey FROM lineitem)"""

LOAN_COLUMNS = "LOAN_ID, CONTRACT_ID, LOAN_TYPE_CDE, LOAN_STATUS_CDE, VALUE, EXTRACT_DTTM"

LOAN_WINNERS = f"""(SELECT {LOAN_COLUMNS} FROM (SELECT *, row_number() OVER (
    PARTITION BY LOAN_ID, EXTRACT_DTTM ORDER BY l_linenumber DESC, l_partkey DESC, l_suppkey DESC)
    AS rn FROM {LOANS}) WHERE rn = 1)"""

FLOWS = f"""(SELECT *, 0 AS shape, NULL::BIGINT AS LOAN_ID, NULL::VARCHAR AS LOAN_TYPE_CDE,
        NULL::VARCHAR AS LOAN_STATUS_CDE, NULL::DECIMAL(22,6) AS VALUE, 0 AS l_linenumber,
        0 AS l_partkey, 0 AS l_suppkey FROM {CONTRACTS}
    UNION ALL BY NAME
    SELECT *, 1 AS shape FROM {LOANS})"""

STAGING_COLUMNS = """CONTRACT_ID, CNTRCT_SHRT_NME, CONTRACT_BRAND_CDE, CONTRACT_TYPE_CDE,
    OPEN_DTE, CLOSE_DTE, EXTRACT_DTTM, LOAN_ID, LOAN_TYPE_CDE, LOAN_STATUS_CDE, VALUE"""

STAGING = f"""(SELECT {STAGING_COLUMNS}, EXTRACT_DTTM AS __START_AT,
    lead(EXTRACT_DTTM) OVER (PARTITION BY CONTRACT_ID ORDER BY EXTRACT_DTTM) AS __END_AT
    FROM (SELECT *, row_number() OVER (PARTITION BY CONTRACT_ID, EXTRACT_DTTM
        ORDER BY shape DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC) AS rn
        FROM {FLOWS}) WHERE rn = 1)"""

_FINAL = """md5('AFSAF' || lpad(CAST(CONTRACT_ID AS VARCHAR), 9, '0')) AS AR_ID, OPEN_DTE,
    coalesce(CAST(CLOSE_DTE AS TIMESTAMP), TIMESTAMP '2999-12-31 00:00:00') AS AR_CLOSE_DTE,
    coalesce(CONTRACT_BRAND_CDE, 'UNKWN') AS BRND_CDE,
    coalesce(CONTRACT_TYPE_CDE, 'UNKWN') AS CONTRACT_TYPE_CDE, CNTRCT_SHRT_NME AS AR_SHRT_NAME,
    CASE WHEN CONTRACT_BRAND_CDE = 'B1' AND LOAN_STATUS_CDE = 'O1' THEN 'CATEGORY 1'
         WHEN CONTRACT_BRAND_CDE = 'B2' AND LOAN_STATUS_CDE = 'O1' THEN 'CATEGORY 2'
         ELSE 'CATEGORY 3' END AS CATEGORY,
    LOAN_TYPE_CDE AS TYPE_CDE, LOAN_STATUS_CDE AS STATUS_CDE, VALUE AS CT_VALUE,
    'AF' AS DATA_SRCE_CDE, 'AFS' AS DATA_SGRGTN_CDE"""

_FINAL_STATE = """(OPEN_DTE, AR_CLOSE_DTE, BRND_CDE, CONTRACT_TYPE_CDE, AR_SHRT_NAME, CATEGORY,
    TYPE_CDE, STATUS_CDE, CT_VALUE)"""

FINAL = f"""WITH f AS (SELECT {_FINAL}, __START_AT FROM {STAGING}),
    g AS (SELECT *, lag({_FINAL_STATE}) OVER w AS prev, row_number() OVER w AS rn FROM f
        WINDOW w AS (PARTITION BY AR_ID, DATA_SGRGTN_CDE ORDER BY __START_AT)),
    h AS (SELECT * EXCLUDE (prev, rn) FROM g
        WHERE rn = 1 OR prev IS DISTINCT FROM {_FINAL_STATE})
    SELECT *, lead(__START_AT) OVER (PARTITION BY AR_ID, DATA_SGRGTN_CDE ORDER BY __START_AT)
        AS __END_AT FROM h"""

TABLE = "'s' || (user_id % 7) AS table_schema, 't' || user_id AS table_name"

def _file(number: int) -> str:
    """One file of an event's source document."""
    sources = [
        f"{{'table': 's' || (user_id % 7) || '.{n}', table_id: md5(user_id || '{n}'), version: CAST(day(ts) AS VARCHAR)}}"
        for n in ("employee", "employee_phone")
    ]
    return f"""{{commit: CAST(day(ts) AS VARCHAR), file_name: 'file_{number}.sql',
        cp_path: '/checkpoints/u' || user_id || '/{number}', incr_type: 'multi', sources: [{", ".join(sources)}]}}"""


AUDIT = f"""(SELECT 'silver' AS layer, {TABLE},
    CASE WHEN event_type IN ('purchase', 'view', 'click') THEN 'success' ELSE 'failed' END
        AS backup_status,
    CASE WHEN event_type NOT IN ('purchase', 'view', 'click') THEN event_type END AS exception,
    CAST(day(ts) AS BIGINT) AS table_version, event_id AS backup_version,
    ts AS backup_timestamp, 'job_' || event_id AS job_id, user_id,
    CAST(to_json({{source_type: 'delta', files: [{_file(1)}, {_file(2)}]}}) AS VARCHAR) AS source_info,
    CAST(to_json({{table_format: 'delta', batch: CASE WHEN user_id % 5 = 0 THEN 'true' ELSE 'false' END}}) AS VARCHAR)
        AS table_info FROM events)"""

DUE = f"""(SELECT h.table_schema, h.table_name, h.head_version,
    coalesce(b.v, -1) AS backed_up_version,
    coalesce(coalesce(b.v, -1) < h.head_version, true) AS due
    FROM (SELECT {TABLE}, CASE WHEN user_id % 11 <> 0 THEN max(day(ts)) END AS head_version
          FROM events GROUP BY user_id) h
    LEFT JOIN (SELECT table_schema, table_name, max(table_version) AS v FROM {AUDIT}
               WHERE backup_status = 'success' GROUP BY ALL) b USING (table_schema, table_name))"""

REQUESTS = f"""(SELECT event_id AS request_id, 'main' AS table_catalog, 'dr' AS dr_table_catalog,
    {TABLE}, CAST(day(ts) AS BIGINT) AS version, event_id % 2 = 0 AS use_checkpoints, user_id
    FROM events WHERE event_type = 'error')"""

PRIMARY = f"""(SELECT {TABLE}, max(day(ts)) - 9 AS base_version, max(day(ts)) AS head_version
    FROM events GROUP BY user_id)"""

BACKUP = f"""(SELECT {TABLE}, min(CASE WHEN event_type = 'purchase' THEN event_id END)
    AS base_version, max(event_id) AS head_version FROM events GROUP BY user_id)"""

PLAN = f"""(SELECT r.*, a.backup_version, a.source_info, a.table_info,
    CASE WHEN r.version BETWEEN p.base_version AND p.head_version THEN 'time_travel'
         WHEN a.backup_version BETWEEN b.base_version AND b.head_version THEN 'backup'
         ELSE 'unavailable' END AS mode
    FROM {REQUESTS} r
    LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY table_schema, table_name, table_version
               ORDER BY backup_timestamp DESC, backup_version DESC) AS rn FROM {AUDIT}
               WHERE backup_status = 'success') a
      ON a.rn = 1 AND a.table_schema = r.table_schema AND a.table_name = r.table_name
         AND a.table_version = r.version
    LEFT JOIN {PRIMARY} p ON p.table_schema = r.table_schema AND p.table_name = r.table_name
    LEFT JOIN {BACKUP} b ON b.table_schema = r.table_schema AND b.table_name = r.table_name)"""

KEYS = "(SELECT c_custkey AS emp_id FROM customer UNION SELECT o_custkey FROM orders)"

EMPLOYEES = """(SELECT c_custkey AS emp_id, c_name AS emp_name, c_mktsegment AS emp_batch_no
    FROM customer)"""

_PHONE = "'04' || lpad(CAST(o_orderkey AS VARCHAR), 8, '0') AS phone, o_orderdate AS extract_dttm"

BATCHES = """(SELECT DISTINCT '/checkpoints/u' || user_id AS cp_path, user_id, 'offsets' AS kind,
        CAST(day(ts) AS BIGINT) AS batch_id FROM events
    UNION ALL
    SELECT DISTINCT '/checkpoints/u' || user_id, user_id, 'commits', CAST(day(ts) AS BIGINT)
    FROM events WHERE event_type = 'purchase')"""

_NEWEST = """SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate,
    o_orderpriority FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey
        ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders"""

ORACLE = {
    "scd2_bronze": HISTORY,
    "scd2_deletes": f"SELECT * FROM ({HISTORY}) WHERE event_type <> 'error'",
    "scd2_staging": f"SELECT * FROM {STAGING}",
    "scd2_final": FINAL,
    "scd2_decimal": f"""SELECT *, EXTRACT_DTTM AS __START_AT, lead(EXTRACT_DTTM) OVER (
        PARTITION BY LOAN_ID ORDER BY EXTRACT_DTTM) AS __END_AT FROM {LOAN_WINNERS}""",
    "scd2_stream": HISTORY,
    "scd2_indexed": HISTORY,
    "scd2_backfill": HISTORY,
    "medallion_chain": FINAL,
    "medallion_incremental": FINAL,
    "file_ingest": HISTORY,
    "as_of": f"SELECT * FROM {_state(10)}",
    "change_feed_range": f"SELECT * FROM {LOG} WHERE _commit_version BETWEEN 5 AND 10",
    "change_feed_initial": f"""SELECT * EXCLUDE (rn)
        REPLACE ('insert' AS _change_type, CAST(5 AS BIGINT) AS _commit_version)
        FROM (SELECT *, row_number() OVER (PARTITION BY user_id
            ORDER BY _commit_version DESC, event_id DESC) AS rn FROM {LOG}
            WHERE _commit_version <= 5) WHERE rn = 1 AND _change_type <> 'delete'
        UNION ALL SELECT * FROM {LOG} WHERE _commit_version > 5""",
    "ingest_evolving": """WITH e AS (SELECT *, day(ts) AS d, CAST(value AS DECIMAL(12,2)) AS exact FROM events)
        SELECT CASE WHEN d <= 20 OR event_type <> 'signup' THEN event_id END AS event_id, event_type,
            CASE WHEN d <= 10 THEN CAST(CAST(floor(exact) AS BIGINT) AS VARCHAR)
                 WHEN d > 20 AND event_type = 'error' THEN 'none' ELSE CAST(exact AS VARCHAR) END AS amount,
            CASE WHEN d BETWEEN 11 AND 20 THEN props END AS props, CASE WHEN d > 20 THEN ts END AS ts,
            CASE WHEN d > 20 AND event_type = 'signup' THEN 'x' || event_id END AS unfit_id, true AS stamped FROM e""",
    "change_feed_follow": f"""SELECT {EVENT}, 'insert' AS _change_type,
            CAST(5 AS BIGINT) AS _commit_version FROM {_state(5)}
        UNION ALL SELECT {EVENT}, _change_type, _commit_version FROM {LOG} WHERE _commit_version > 5""",
    "backup_consistency": f"""WITH late AS (SELECT {EVENT} FROM events WHERE day(ts) > 24),
        other AS (SELECT * REPLACE (CASE WHEN event_type = 'signup' THEN -value ELSE value END AS value)
            FROM late WHERE event_type <> 'error')
        SELECT *, 'left' AS side, 'apart' AS stage FROM (FROM late EXCEPT ALL FROM other)
        UNION ALL SELECT *, 'right', 'apart' FROM (FROM other EXCEPT ALL FROM late)""",
    "table_diff_tree": f"""SELECT *, 'left' AS side FROM (FROM {_state(27)} EXCEPT ALL FROM {_state(28)})
        UNION ALL SELECT *, 'right' FROM (FROM {_state(28)} EXCEPT ALL FROM {_state(27)})""",
    "change_feed_stream": f"""SELECT {EVENT}, CAST(day(ts) AS INTEGER) AS version
        FROM events WHERE day(ts) >= 5""",
    "change_feed_diff": f"""WITH o AS (SELECT * FROM {_state(10)}),
        n AS (SELECT * FROM {_state(20)}),
        changed AS (SELECT o AS o, n AS n FROM o FULL JOIN n ON o.user_id = n.user_id
            WHERE o IS DISTINCT FROM n)
        SELECT n.*, 'insert' AS _change_type FROM n ANTI JOIN o USING (user_id)
        UNION ALL SELECT o.*, 'delete' FROM o ANTI JOIN n USING (user_id)
        UNION ALL SELECT o.*, 'update_preimage' FROM o JOIN n USING (user_id)
            WHERE o.event_id IS DISTINCT FROM n.event_id
        UNION ALL SELECT n.*, 'update_postimage' FROM o JOIN n USING (user_id)
            WHERE o.event_id IS DISTINCT FROM n.event_id""",
    "net_changes": f"""WITH o AS (SELECT * FROM {_state(25)}),
        n AS (SELECT * FROM {_state(28)})
        SELECT n.*, 'insert' AS _change_type FROM n ANTI JOIN o USING (user_id)
        UNION ALL SELECT o.*, 'delete' FROM o ANTI JOIN n USING (user_id)
        UNION ALL SELECT o.*, 'update_preimage' FROM o JOIN n USING (user_id)
            WHERE o.event_id IS DISTINCT FROM n.event_id
        UNION ALL SELECT n.*, 'update_postimage' FROM o JOIN n USING (user_id)
            WHERE o.event_id IS DISTINCT FROM n.event_id""",
    "table_history": f"""SELECT _commit_version, max(_commit_timestamp) AS _commit_timestamp,
        count(*) FILTER (_change_type = 'insert') AS inserts,
        count(*) FILTER (_change_type = 'update_postimage') AS update_postimages,
        count(*) FILTER (_change_type = 'delete') AS deletes
        FROM {LOG} GROUP BY _commit_version""",
    "compact_log": f"SELECT * FROM {_state(20)}",
    "clone_table": f"SELECT * FROM {_state(31)}",
    "clone_as_of": f"SELECT * FROM {_state(10)}",
    "restore_version": f"SELECT * FROM {_state(10)}",
    "restart_fenced": f"FROM {_state(31)}",
    "overwrite_schema": f"""WITH a AS (SELECT {EVENT}, 0 AS version FROM {_state(10)}),
        b AS (SELECT user_id, event_id, event_type AS kind, CAST(value AS DECIMAL(12,2)) AS value,
            CAST(day(ts) AS INTEGER) AS day, 1 AS version FROM {_state(20)})
        SELECT * REPLACE (CAST(value AS DECIMAL(12,2)) AS value) FROM a
        UNION ALL BY NAME FROM b UNION ALL BY NAME SELECT * EXCLUDE (day) REPLACE (2 AS version) FROM b""",
    "catalog_kind": """SELECT 'plain' AS name, 'EXTERNAL' AS table_type, 'delta' AS kind,
            NULL::VARCHAR AS pipeline_id, count(*) AS rows FROM part
        UNION ALL SELECT 'kept', 'EXTERNAL', 'dlt', 'a_1', count(*) FROM supplier
        UNION ALL SELECT 'seen', 'VIEW', 'delta', NULL, count(*) FROM part WHERE p_size > 10""",
    "stream_checkpoints": """SELECT 'orders' AS stream, 0::BIGINT AS source_no, 1::BIGINT AS position,
            2::BIGINT AS files, 2::BIGINT AS batches, 'dedupe' AS operator, count(DISTINCT o_custkey) AS keys FROM orders
        UNION ALL SELECT 'events', 0, 1, 2, 2, NULL, NULL""",
    "table_diff": f"""WITH o AS (SELECT user_id, event_type FROM {_state(10)}),
        n AS (SELECT user_id, event_type FROM {_state(20)})
        SELECT *, 'left' AS side FROM (SELECT * FROM o EXCEPT SELECT * FROM n)
        UNION ALL SELECT *, 'right' FROM (SELECT * FROM n EXCEPT SELECT * FROM o)""",
    "table_diff_strict": """SELECT *, 'left' AS side FROM (SELECT l_orderkey FROM lineitem
            EXCEPT ALL SELECT o_orderkey FROM orders)
        UNION ALL SELECT *, 'right' FROM (SELECT o_orderkey FROM orders
            EXCEPT ALL SELECT l_orderkey FROM lineitem)""",
    "merge_upsert": f"""WITH t AS ({_NEWEST} WHERE o_orderdate < TIMESTAMP '1998-01-01')
            WHERE rn = 1),
        u AS ({_NEWEST} WHERE o_orderdate >= TIMESTAMP '1998-01-01') WHERE rn = 1)
        SELECT * FROM t ANTI JOIN u USING (o_custkey) UNION ALL BY NAME SELECT * FROM u""",
    "changed_keys": f"SELECT emp_id FROM {KEYS}",
    "changed_key_enrich": f"""SELECT k.emp_id, emp_name, emp_batch_no, phone, extract_dttm
        FROM {KEYS} k LEFT JOIN {EMPLOYEES} e ON k.emp_id = e.emp_id
        LEFT JOIN (SELECT o_custkey AS emp_id, {_PHONE} FROM orders) p ON k.emp_id = p.emp_id""",
    "stream_upsert": f"""SELECT k.emp_id, emp_name, emp_batch_no, phone, extract_dttm
        FROM {KEYS} k LEFT JOIN {EMPLOYEES} e ON k.emp_id = e.emp_id
        LEFT JOIN (SELECT o_custkey AS emp_id, {_PHONE} FROM ({_NEWEST}) WHERE rn = 1)) p
        ON k.emp_id = p.emp_id""",
    "stream_append": f"SELECT {EVENT} FROM events",
    "stream_resume": f"SELECT {EVENT} FROM events",
    "append_flows": f"""SELECT * FROM {CONTRACTS}
        UNION ALL BY NAME SELECT {LOAN_COLUMNS} FROM {LOANS}""",
    "dedupe_columns": "SELECT DISTINCT l_orderkey, l_linenumber, l_returnflag FROM lineitem",
    "materialized_view": f"SELECT * FROM {CONTRACTS}",
    "view_over_stream": f"""SELECT event_type, __END_AT IS NULL AS is_open, count(*) AS rows,
        CAST(sum(CAST(value AS DECIMAL(20,2))) AS DECIMAL(38,2)) AS value FROM ({HISTORY}) GROUP BY 1, 2""",
    "view_of_changes": f"""SELECT event_type, count(*) AS rows,
        CAST(sum(CAST(value AS DECIMAL(20,2))) AS DECIMAL(38,2)) AS value,
        CAST(sum(event_id) AS DECIMAL(38,0)) AS event_id FROM {_state(31)} GROUP BY 1""",
    "stream_distinct": "SELECT DISTINCT o_custkey FROM orders",
    "backup_run": f"""SELECT 's' AS table_schema, 'users' AS table_name, 'success' AS backup_status,
            NULL::VARCHAR AS exception, (SELECT max(day(ts)) FROM events) AS table_version,
            count(*) AS rows, sum(event_id)::BIGINT AS total, 1::BIGINT AS sources FROM {_state(31)}
        UNION ALL SELECT 's', 'orders', 'success', NULL, 4, count(*), sum(o_orderkey)::BIGINT, NULL FROM orders
        UNION ALL SELECT 's', 'missing', 'failed', 'table not found', NULL, NULL, NULL, NULL""",
    "surrogate_key": """SELECT c_custkey, md5(concat_ws('', 'AFS', 'AF',
        lpad(CAST(c_custkey AS VARCHAR), 9, '0'))) AS ar_id FROM customer""",
    "silver_transform": f"""SELECT {_FINAL}, CONTRACT_ID FROM (SELECT {_CONTRACT},
        substr(o_orderpriority, 1, 1) AS LOAN_TYPE_CDE,
        CASE WHEN o_totalprice > 200000 THEN 'O1' ELSE 'C1' END AS LOAN_STATUS_CDE,
        CAST(o_totalprice AS DECIMAL(22,6)) AS VALUE FROM orders)""",
    "json_field": "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events",
    "checkpoint_paths": r"""WITH c AS (SELECT replace(p_name, ' ', '_') AS target_table,
            CASE WHEN p_size % 3 <> 0 THEN p_type || '.sql' END AS filename,
            CASE WHEN p_size % 4 = 0 THEN p_brand END AS incr_source_table,
            CASE WHEN p_size % 5 <> 0 THEN [p_brand, p_type, 'x'] ELSE [NULL] END AS items
            FROM part),
        e AS (SELECT target_table, filename, incr_source_table,
            unnest(items) AS multi_source_db_tbls FROM c)
        SELECT DISTINCT *, CASE
            WHEN incr_source_table IS NOT NULL THEN target_table || '/' || incr_source_table
            ELSE concat_ws('/', target_table, coalesce(filename, target_table || '.sql'),
                multi_source_db_tbls) END AS checkpoints_path FROM e""",
    "table_kind": """SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'dlt' ELSE 'delta' END AS kind,
        CASE WHEN p_size % 2 = 0 THEN p_type || '_' || p_partkey END AS pipeline_id FROM part""",
    "latest_backup": f"""SELECT table_schema, table_name, max(table_version) AS backed_up_version
        FROM {AUDIT} WHERE backup_status = 'success' GROUP BY table_schema, table_name""",
    "backup_due": f"SELECT * FROM {DUE}",
    "backup_audit": f"""SELECT * EXCLUDE (user_id) FROM {AUDIT} UNION ALL BY NAME
        SELECT 'silver' AS layer, table_schema, table_name,
            CASE WHEN head_version IS NULL THEN 'failed' ELSE 'success' END AS backup_status,
            CASE WHEN head_version IS NULL THEN 'table not found' END AS exception,
            head_version AS table_version, head_version AS backup_version,
            TIMESTAMP '2024-02-01 00:00:00' AS backup_timestamp, 'job_run' AS job_id
        FROM {DUE} WHERE due""",
    "restore_plan": f"SELECT * EXCLUDE (user_id) FROM {PLAN}",
    "version_available": f"""SELECT r.request_id, r.table_name, r.version,
        r.version BETWEEN p.base_version AND p.head_version AS available FROM {REQUESTS} r
        JOIN {PRIMARY} p ON p.table_schema = r.table_schema AND p.table_name = r.table_name""",
    "source_info_flat": """SELECT event_id AS backup_version, 'delta' AS source_type,
        CAST(f.n - 1 AS BIGINT) AS file_no, CAST(day(ts) AS VARCHAR) AS commit,
        'file_' || f.n || '.sql' AS file_name,
        '/checkpoints/u' || user_id || '/' || f.n AS cp_path, 'multi' AS incr_type,
        CAST(s.n AS BIGINT) AS source_no, 's' || (user_id % 7) || '.' || s.name AS "table",
        md5(user_id || s.name) AS table_id, CAST(day(ts) AS VARCHAR) AS version
        FROM events, (VALUES (1), (2)) f(n),
        (VALUES (0, 'employee'), (1, 'employee_phone')) s(n, name)""",
    "restart_config": f"""WITH p AS (SELECT *, backup_version IS NOT NULL AS recorded,
            backup_version IS NOT NULL AND user_id % 5 = 0 AS batch FROM {PLAN}),
        r AS (SELECT *, mode <> 'unavailable' AND recorded AND NOT batch AND use_checkpoints
                AND EXISTS (SELECT 1 FROM events e WHERE e.user_id = p.user_id
                    AND e.event_type = 'purchase' AND day(e.ts) = p.version) AS resume FROM p),
        d AS (SELECT *, CASE WHEN mode = 'unavailable' THEN 'no readable version'
                WHEN NOT recorded THEN 'no recorded sources' END AS reason,
            CASE WHEN resume THEN '' ELSE ',"version":"' || version || '"' END AS v FROM r),
        f AS (SELECT *, '{{"sources":[{{"table":"' || table_schema || '.employee"' || v
            || '}},{{"table":"' || table_schema || '.employee_phone"' || v || '}}]}}' AS file FROM d)
        SELECT request_id, mode, batch, resume, reason, CASE WHEN reason IS NULL THEN
            '{{"table":"main.' || table_schema || '.' || table_name || '","source_info":'
            || CASE WHEN batch THEN '"NA - run as batch table"'
               ELSE '{{"source_type":"delta","files":[' || file || ',' || file || ']}}' END
            || '}}' END AS config
        FROM f""",
    "ingested_files": """SELECT 'events' AS name, CAST(0 AS BIGINT) AS "batchId",
            count(*) AS rows FROM events
        UNION ALL SELECT 'orders', CAST(0 AS BIGINT), count(*) FROM orders""",
    "checkpoint_progress": f"""WITH last AS (SELECT user_id, max(batch_id) AS batch_id
            FROM {BATCHES} WHERE kind = 'commits' GROUP BY user_id)
        SELECT '/checkpoints/u' || user_id AS cp_path, batch_id,
            CAST(list_position(['view', 'click', 'error', 'purchase', 'signup'], event_type) - 1
                AS BIGINT) AS source_no,
            CASE WHEN event_type IN ('view', 'click') THEN max(event_id) END AS position,
            CASE WHEN event_type NOT IN ('view', 'click') THEN event_type END AS source_id,
            CASE WHEN event_type NOT IN ('view', 'click') THEN max(event_id) + count(*) END
                AS version
        FROM events JOIN last USING (user_id) WHERE day(ts) = batch_id
        GROUP BY user_id, batch_id, event_type""",
    "source_progress": """SELECT event_type AS source_id, max(event_id) - 1 AS version
        FROM events WHERE event_type NOT IN ('view', 'click') GROUP BY event_type""",
    "restart_plan": f"""WITH rec AS (SELECT user_id // 2 AS request_id, user_id,
            CAST(max(day(ts)) AS BIGINT) AS commit, (user_id // 2) % 3 <> 0 AS use_checkpoints
            FROM events WHERE event_type = 'signup' GROUP BY user_id),
        ok AS (SELECT request_id, bool_and(use_checkpoints AND
                EXISTS (SELECT 1 FROM {BATCHES} b WHERE b.user_id = rec.user_id
                    AND b.batch_id = rec.commit AND b.kind = 'commits')
                AND EXISTS (SELECT 1 FROM {BATCHES} b WHERE b.user_id = rec.user_id
                    AND b.batch_id = rec.commit AND b.kind = 'offsets')) AS resume
            FROM rec GROUP BY request_id)
        SELECT request_id, cp_path, kind, batch_id,
            CASE WHEN NOT resume THEN 'reset' WHEN batch_id > commit THEN 'drop' ELSE 'keep' END
                AS action
        FROM {BATCHES} JOIN rec USING (user_id) JOIN ok USING (request_id)""",
}
