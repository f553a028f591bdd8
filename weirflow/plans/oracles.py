"""The registered queries once more, as SQL written apart from the expressions: what they are held against."""

from __future__ import annotations

_RAW = """raw as (
    select o_orderkey as seq, 'acct_' || (o_custkey % 4) as provider_account_id,
        strftime(date_trunc('year', o_orderdate), '%d/%m/%y') || ' 10:30' as ts_raw,
        case when o_orderstatus = 'P' then '' else strftime(date_trunc('year', o_orderdate) + interval 30 day, '%d/%m/%y') end as charge_raw,
        c_mktsegment as card_name, o_orderpriority as business_name, o_orderstatus as expense_type,
        ['$', '€', '£', '₪', 'RON', 'USD ', 'JPY'][(o_orderkey % 7 + 1)::int] || cast((floor(o_totalprice / 100000) * 100000 + 97.3)::decimal(18, 2) as varchar) as amount_raw,
        case when o_orderkey % 11 = 0 then '' else '₪' || cast(((floor(o_totalprice / 100000) * 100000 + 97.3)::decimal(18, 2) * 3)::decimal(18, 2) as varchar) end as charge_amount_raw,
        case when o_orderkey % 13 = 0 then 'status: amount not final' else 'status: settled' end as panel_text
    from orders left join customer on o_custkey = c_custkey)"""


def _amount(c: str) -> str:
    return rf"coalesce(try_cast(replace(nullif(regexp_extract({c}, '-?\d[\d,]*(?:\.\d+)?'), ''), ',', '') as double), 0)"


def _currency(c: str) -> str:
    return f"""case when contains({c}, '$') then 'USD' when contains({c}, '€') then 'EUR' when contains({c}, '£') then 'GBP' when contains({c}, '₪') then 'ILS'
        else coalesce(list_filter(regexp_split_to_array(upper({c}), '[^A-Z]+'), lambda z: z in ('ILS', 'USD', 'EUR', 'GBP', 'RON'))[1], 'ILS') end"""


def _date(c: str) -> str:
    return rf"case when regexp_matches({c}, '\d\d/\d\d/\d\d') then regexp_replace(regexp_extract({c}, '\d\d/\d\d/\d\d'), '(\d\d)/(\d\d)/(\d\d)', '20\3-\2-\1') else '' end"


def _number(c: str) -> str:
    return rf"case when {c} = 0 then '0' else regexp_replace(cast({c} as varchar), '\.0$', '') end"


_TXN = f"""{_RAW}, txn as (
    select seq, 'CAL' as provider, coalesce(card_name, '') as account_id, provider_account_id, {_date('ts_raw')} as transaction_date,
        {_date('charge_raw')} as charge_date, business_name as merchant_name, expense_type as category, {_amount('amount_raw')} as amount,
        {_currency('amount_raw')} as currency, coalesce(nullif({_amount('charge_amount_raw')}, 0), {_amount('amount_raw')}) as charge_amount,
        {_currency('charge_amount_raw')} as charge_currency, 'regular' as transaction_type,
        case when charge_raw <> '' then 'completed' else 'pending' end as status, amount_raw
    from raw)"""

_HASHED = f"""{_TXN}, hashed as (
    select *, substr(sha256(concat_ws('|', provider, account_id, transaction_date, merchant_name, {_number('amount')}, currency, transaction_type)), 1, 16) as fp,
        substr(sha256(concat_ws('|', status, charge_date, {_number('charge_amount')}, charge_currency, category)), 1, 16) as content_hash
    from txn)"""


#: Every customer's account descriptor, as it is stored.
_DESCRIBED = """described as (
    select c_nationkey, c_custkey as seq, case when bad then 'cal' else lower(c_mktsegment) end as provider, case when bad then 'default' else c_custkey::varchar end as account, case when bad then '' else c_name end as display_name,
        bad or c_custkey % 3 <> 0 as enabled, not bad and c_custkey % 7 = 3 as marked, case when not bad and c_custkey % 4 in (2, 3) then c_custkey % 400 end as days_back,
        case when not bad then 'USER_' || c_nationkey end as username_env, case when not bad then 'PASS_' || (c_custkey % 5) end as password_env
    from (select *, c_custkey % 11 = 0 as bad from customer))"""


def _occurrence(source: str) -> str:
    return f"(select *, fp || case when n = 1 then '' else '|#' || n end as dedup_key from (select *, row_number() over (partition by provider, provider_account_id, fp order by seq) as n from {source}))"


_KEYED = f"{_HASHED}, keyed as {_occurrence('hashed')}"
_SEEN = f"""{_KEYED}, seen as (
    select provider, provider_account_id, dedup_key, case seq % 10 when 5 then null when 3 then '0000000000000000' else content_hash end as content_hash
    from {_occurrence("(select * from hashed where seq % 10 < 7)")})"""
_CLASSIFIED = f"""{_SEEN}, classified as (
    select k.*, case when s.dedup_key is null then 'created' when s.content_hash is null or s.content_hash = k.content_hash then 'unchanged' else 'updated' end as kind,
        case when s.dedup_key is null then 'new' when s.content_hash is null or s.content_hash = k.content_hash then 'unchanged' else 'updated' end as local_dedup_status
    from keyed k left join seen s on k.provider_account_id = s.provider_account_id and k.dedup_key = s.dedup_key)"""
#: The same without pending rows: their keys aren't numbered, nor in the way of others.
_FINAL = _CLASSIFIED.replace(f"keyed as {_occurrence('hashed')}", f"keyed as {_occurrence('(select * from hashed where seq % 13 <> 0)')}")
_LEDGER = f"""{_CLASSIFIED}, ledger as (
    select provider, provider_account_id, dedup_key, seq % 10 as k, case seq % 10 when 3 then 'failed' else 'sent' end as finance_status,
        case seq % 10 when 0 then content_hash when 1 then '0000000000000000' end as content_hash, case seq % 10 when 3 then 500 else 201 end as api_status,
        case when seq % 10 <> 3 then 'fin_' || seq end as finance_transaction_id
    from keyed where seq % 10 < 4)"""
_DECIDED = f"""{_LEDGER}, reasoned as (
    select c.*, l.finance_status as old_status, case when c.status <> 'completed' then 'transaction_not_completed'
        when not c.charge_amount > 0 then 'charge_amount_zero_or_negative'
        when l.finance_status = 'sent' and l.content_hash is not null and l.content_hash <> c.content_hash then 'already_sent_content_changed'
        when l.finance_status = 'sent' then 'already_sent_successfully' end as reason
    from classified c left join ledger l on c.provider_account_id = l.provider_account_id and c.dedup_key = l.dedup_key),
decided as (select *, case when reason is null then 'send' when reason = 'already_sent_successfully' then 'already_sent' else 'skipped' end as decision from reasoned)"""
_FINISHED = f"""{_DECIDED}, finished as (
    select * exclude (reason), case when decision <> 'send' then decision when seq % 17 = 0 or seq % 19 = 0 then 'failed' else 'sent' end as finance_status,
        case when decision <> 'send' then reason when seq % 17 = 0 then 'api_error' when seq % 19 = 0 then 'api_validation_failed' else 'sent' end as reason,
        case when decision = 'send' then case when seq % 17 = 0 then 500 when seq % 19 = 0 then 422 else 201 end end as new_status,
        case when decision = 'send' and seq % 17 <> 0 and seq % 19 <> 0 then 'new_' || seq end as new_id
    from decided)"""

_COUNTERS = """count(*) filter (where local_dedup_status = 'new') as created, count(*) filter (where local_dedup_status = 'updated') as updated,
    count(*) filter (where local_dedup_status = 'unchanged') as unchanged, count(*) filter (where local_dedup_status = 'duplicate') as duplicates,
    count(*) filter (where local_dedup_status in ('new', 'updated')) as exported, count(*) as considered"""

_ACCOUNTS = """accounts as (
    select c_custkey as seq, 'cal' as provider, coalesce(case when c_custkey % 3 <> 0 then c_name end, case when c_custkey % 6 = 0 then 'old' end, 'default') as provider_account_id,
        case when c_custkey % 4 <> 0 then c_mktsegment end as given, coalesce(case when c_custkey % 5 <> 0 then c_custkey % 5 <> 1 end, true) as enabled,
        c_custkey % 7 = 0 or c_custkey % 50 = 0 as is_default, c_custkey % 50 = 0 as flag, case when c_custkey % 4 = 0 then (c_custkey // 4)::int end as days_back, c_nationkey
    from customer)"""

_RUNS = """runs as (
    select event_id as e, 'CAL' as provider, user_id::varchar as provider_account_id, event_type as display_name, ts, date_trunc('second', ts) + to_seconds(event_id % 100) as finished,
        case when event_type = 'error' then 'failed' when event_id % 3 = 0 then 'partial' else 'success' end as status,
        case when event_id % 9 <> 0 then floor(value)::bigint end as fetched
    from events)"""
_RESULT = """provider, provider_account_id, e % 2 = 0 as session_reused, coalesce(fetched, 0) as transactions_fetched, e % 2 as pending_skipped, e % 4 as skipped,
    e % 12 as created, e % 7 as updated, e % 13 as unchanged, e % 3 as duplicates, e % 12 + e % 7 as exported, null::varchar as export_path"""
_LAST = "strftime(date_trunc('second', finished), '%Y-%m-%d %H:%M:%S') as last_run_at, e % 100 * 1000 as last_run_duration_ms, status as last_run_status, provider as last_run_provider"

_REASONS = """[('run_mode_fetch_only', 'Fetch Only run — finance was not contacted'), ('finance_disabled', 'finance integration is disabled'), ('missing_api_url', 'the finance API URL is not set'),
    ('missing_api_key', 'no finance API key is saved'), ('fetch_failed', 'the fetch failed, so nothing was synced'), ('transaction_not_completed', 'transaction is not completed yet'),
    ('charge_amount_zero_or_negative', 'no positive charge amount'), ('already_sent_successfully', 'already sent to finance previously'),
    ('already_sent_content_changed', 'already sent, but details changed since — review needed'), ('duplicate_in_current_batch', 'duplicate within this batch'),
    ('api_validation_failed', 'finance API rejected the transaction'), ('api_error', 'finance API/network error'), ('other', 'other'), ('', 'unknown reason')]"""

ORACLES = {
    "parse_amount": f"with {_RAW} select seq, amount_raw, {_amount('amount_raw')} as amount, {_amount('charge_amount_raw')} as charge_amount from raw",
    "detect_currency": f"with {_RAW} select seq, {_currency('amount_raw')} as currency, {_currency('card_name')} as card_currency, {_currency('charge_amount_raw')} as charge_currency from raw",
    "parse_date": f"with {_RAW} select seq, {_date('ts_raw')} as transaction_date, {_date('charge_raw')} as charge_date from raw",
    "pending_marker": "select doc_id, case when contains(text, 'with the of') then 'with the of' when contains(text, 'the that') then 'the that' when contains(text, 'and of') then 'and of' when contains(text, 'de la') then 'de la' when contains(text, 'der die') then 'der die' end as marker from documents",
    "pending_filter": f"with {_RAW} select provider_account_id, count(*) filter (where contains(panel_text, 'amount not final')) as pending_skipped, count(*) filter (where not contains(panel_text, 'amount not final')) as kept from raw group by 1",
    "pending_text": "select doc_id, case when doc_id % 3 = 0 or trim(coalesce(lang, '')) = '' then source else trim(lang) end as status_text from documents",
    "number_text": f"select l_orderkey, l_linenumber, {_number('l_extendedprice')} as price, {_number('l_quantity')} as quantity, {_number('(-l_discount)')} as discount from lineitem",
    "redact_text": "select doc_id, replace(replace(replace(coalesce(text, ''), 'token', '[REDACTED]'), 'the', '[REDACTED]'), 'que', '[REDACTED]') as redacted from documents",
    "safe_url": r"""select page_id, case when regexp_matches(url, '^https?://[^/?#]+') then regexp_extract(url, '^(https?)://', 1) || '://'
        || regexp_replace(lower(regexp_replace(regexp_extract(url, '^[^:]+://([^/?#]*)', 1), '^.*@', '')), case when starts_with(url, 'https') then ':443$' else ':80$' end, '')
        || coalesce(nullif(regexp_extract(url, '^[^:]+://[^/?#]*([^?#]*)', 1), ''), '/') else '[invalid-url]' end as url from pages""",
    "truncate_text": "select doc_id, case when length(text) > 200 then substr(text, 1, 200) || '…[truncated]' else coalesce(text, '') end as snippet from documents",
    "one_line": r"select doc_id, substr(trim(regexp_replace(text, '[ \t\n\r\f\x0B]+', ' ', 'g')), 1, 200) as line from documents",
    "csv_rows": """select doc_id, doc_id || ',' || case when regexp_matches(text, '[",\n\r]') then '"' || replace(text, '"', '""') || '"' else coalesce(text, '') end || ',' || coalesce(lang, '') || ',' as line from documents""",
    "html_escape": """select page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') as escaped from pages""",
    "file_name": "select page_id, lower(regexp_replace(url, '[^a-zA-Z0-9_-]', '_', 'g')) as name from pages",
    "state_name": "select c_custkey, case when c_custkey % 3 = 2 then 'cal_' || c_name else 'cal' end as name from customer",
    "secret_scrub": "select doc_id, replace(source, 'src1', '[REDACTED]') as a, lang || ',' || replace(source, 'src1', '[REDACTED]') as b from documents",
    "auth_failure": "select event_id, event_id % 5 = 0 or event_id % 7 = 0 as auth, event_id % 5 = 1 as timeout from events",
    "backoff_schedule": "select n_nationkey, floor(1000 * pow(1.5, n_nationkey) + 0.5)::bigint as wait, floor(100 * pow(2.0, n_nationkey) + 0.5)::bigint as doubling from nation",
    "extract_detail": "select o_orderkey, case when o_orderkey % 2 = 0 then o_orderstatus else 'later' end as status, trim(o_orderpriority) as priority, '' as missing from orders",
    "normalize_txn": f"with {_TXN} select * exclude (amount_raw) from txn",
    "source_stamp": f"with {_TXN} select seq, case when seq % 2 = 0 then 'other' else provider end as provider, 'main' as provider_account_id, 'Main card' as provider_display_name from txn",
    "lookback_window": f"with {_TXN} select seq, transaction_date from txn where transaction_date >= strftime(date '1996-06-15' - 365, '%Y-%m-%d')",
    "resume_slice": f"with {_TXN} select seq, merchant_name from txn where seq >= 1000",
    "segment_union": f"with {_TXN} select seq, merchant_name, (seq >= 1000)::int as segment from txn",
    "fingerprint": f"with {_HASHED} select seq, fp as fingerprint from hashed",
    "content_hash": f"with {_HASHED} select seq, content_hash from hashed",
    "occurrence_keys": f"with {_KEYED} select seq, provider_account_id, dedup_key from keyed",
    "within_run_dedup": "select event_id as seq, row_number() over (partition by event_type, user_id order by event_id) > 1 as repeated from events",
    "classify_incremental": f"with {_CLASSIFIED} select seq, dedup_key, kind, local_dedup_status from classified",
    "full_fetch": f"with {_TXN} select provider, provider_account_id, count(*) as created, 0::bigint as updated, 0::bigint as unchanged, 0::bigint as duplicates, count(*) as exported, count(*) as considered from txn group by 1, 2",
    "export_delta": f"with {_CLASSIFIED} select seq, dedup_key, local_dedup_status from classified where kind <> 'unchanged'",
    "considered_counts": f"with {_CLASSIFIED} select provider, provider_account_id, {_COUNTERS} from classified group by 1, 2",
    "new_rows_anti": f"with {_SEEN} select seq, dedup_key from keyed k where not exists (select 1 from seen s where s.provider_account_id = k.provider_account_id and s.dedup_key = k.dedup_key)",
    "seen_rows_semi": f"with {_SEEN} select seq, dedup_key from keyed k where exists (select 1 from seen s where s.provider_account_id = k.provider_account_id and s.dedup_key = k.dedup_key)",
    "seen_upsert": f"""with {_CLASSIFIED} select coalesce(s.provider, d.provider) as provider, coalesce(s.provider_account_id, d.provider_account_id) as provider_account_id, coalesce(s.dedup_key, d.dedup_key) as dedup_key,
        coalesce(d.content_hash, s.content_hash) as content_hash, case when d.dedup_key is not null then '2026-01-02 03:04:05' else '2025-12-01 00:00:00' end as last_seen_at,
        case when d.kind = 'updated' then '2026-01-02 03:04:05' end as updated_at
        from seen s full join (select * from classified where kind <> 'unchanged') d on s.provider_account_id = d.provider_account_id and s.dedup_key = d.dedup_key""",
    "seen_migrate": """select 'cal' as provider, c_custkey::varchar as provider_account_id, 'k' || c_custkey as dedup_key, 'h' || c_custkey as content_hash, '2026-01-02 03:04:05' as last_seen_at, null::varchar as updated_at from customer where c_custkey % 3 = 0
        union all select 'cal', c_custkey::varchar, x || c_custkey, null, null, null from customer, (values ('a'), ('b')) v(x) where c_custkey % 3 = 1""",
    "run_status": "select event_id, case when event_type = 'error' then 'failed' when event_id % 4 = 0 then 'partial' else 'success' end as status from events",
    "should_send": f"with {_TXN} select seq, status = 'completed' and charge_amount > 0 as send from txn",
    "plan_export": f"with {_TXN} select count(*) as total, count(*) filter (where status = 'completed' and charge_amount > 0) as qualifying, count(*) filter (where not (status = 'completed' and charge_amount > 0)) as skipped from txn",
    "resolve_amount": f"with {_TXN} select seq, case when seq % 5 > 1 and amount > 0 then amount when seq % 2 = 1 and amount > 0 then amount when charge_amount > 0 then charge_amount end as original_amount from txn",
    "payload": f"""with {_KEYED} select seq, 'expense' as type, charge_amount as amount, transaction_date as date, merchant_name as description, charge_date, account_id as payment_source_name, currency,
        case when amount > 0 then amount when charge_amount > 0 then charge_amount end as original_amount, dedup_key as external_id from keyed where status = 'completed' and charge_amount > 0""",
    "http_classify": """with s as (select event_id, case when event_id % 7 <> 0 then (floor(value)::bigint % 400 + 200)::int end as status from events)
        select event_id, case when event_id % 11 = 0 then 'api_validation_failed' when status between 200 and 299 then null when status between 400 and 499 then 'api_validation_failed' else 'api_error' end as classification,
        coalesce(status not in (401, 403), false) as reachable from s""",
    "response_id": "select event_id, case event_id % 5 when 0 then (props->>'$.k') when 1 then 't' || (props->>'$.k') when 2 then 'd' || (props->>'$.k') end as found from events",
    "ledger_decide": f"with {_DECIDED} select seq, decision, reason from decided",
    "ledger_merge": f"""with {_FINISHED}, tried as (select * from finished where decision = 'send')
        select coalesce(l.provider, t.provider) as provider, coalesce(l.provider_account_id, t.provider_account_id) as provider_account_id, coalesce(l.dedup_key, t.dedup_key) as dedup_key,
        coalesce(t.finance_status, l.finance_status) as finance_status, case when t.finance_status = 'sent' then 'already_sent_successfully' when t.finance_status = 'failed' then t.reason when l.k = 3 then 'api_error' else 'already_sent_successfully' end as reason,
        case when t.finance_status = 'sent' then t.content_hash else l.content_hash end as content_hash, coalesce(t.new_status, l.api_status) as api_status, coalesce(t.new_id, l.finance_transaction_id) as finance_transaction_id,
        case when t.finance_status = 'sent' then '2026-01-02 03:04:05' when l.k <> 3 then '2025-12-01 00:00:00' end as sent_at, case when t.dedup_key is not null then '2026-01-02 03:04:05' else '2025-12-01 00:00:00' end as last_attempt_at,
        ((l.dedup_key is not null)::int + (t.dedup_key is not null)::int) as attempts
        from ledger l full join tried t on l.provider_account_id = t.provider_account_id and l.dedup_key = t.dedup_key""",
    "audit_rows": f"""with {_FINISHED} select 'run-1' as "runId", '2026-01-02 03:04:05' as timestamp, provider, provider_account_id as "accountId", '' as "accountLabel", transaction_date as "transactionDate", merchant_name as merchant, amount,
        charge_amount as "chargeAmount", currency, status, local_dedup_status as "localDedupStatus", finance_status as "financeStatus", reason, new_status::varchar as "apiStatus", new_id as "financeTransactionId", dedup_key as "dedupKey" from finished""",
    "sync_counts": f"""with {_FINISHED} select count(*) as considered, count(*) filter (where finance_status = 'sent') as sent, count(*) filter (where finance_status = 'already_sent') as already_sent,
        count(*) filter (where finance_status = 'skipped') as skipped, count(*) filter (where finance_status = 'failed') as failed, 0::bigint as not_attempted from finished""",
    "sync_gates": "select c_custkey, case when c_custkey % 2 <> 0 then 'finance_disabled' when c_custkey % 3 <> 0 then 'missing_api_url' when c_custkey % 5 = 0 then 'missing_api_key' when c_custkey % 7 = 0 then 'fetch_failed' end as gate from customer",
    "reason_text": f"select event_id, ({_REASONS}[(event_id % 14 + 1)::int])[2] as said from events",
    "account_normalize": f"with {_ACCOUNTS} select seq, provider, provider_account_id, coalesce(given, 'CAL (' || provider_account_id || ')') as display_name, enabled, is_default, days_back::varchar as days_back from accounts",
    "account_select": f"with {_ACCOUNTS} select seq, provider_account_id from accounts where enabled",
    "default_account": f"with {_ACCOUNTS} select seq, is_default from accounts order by is_default desc, seq limit 1",
    "single_default": f"with {_ACCOUNTS} select seq, c_nationkey, row_number() over (partition by c_nationkey order by flag desc, seq) = 1 as is_default from accounts",
    "effective_days_back": f"with {_ACCOUNTS} select seq, coalesce(days_back, 9) as days_back, case when days_back between 1 and 365 then days_back::varchar end as valid from accounts",
    "unused_credentials": "select s_suppkey::varchar as credential_key from supplier where s_suppkey not in (select n_nationkey from nation)",
    "metrics_rollup": f"""with {_RUNS}, l as (select {_LAST} from runs order by e desc limit 1) select count(*) as total_runs, count(*) filter (where status = 'success') as successful_runs, count(*) filter (where status = 'partial') as partial_runs,
        count(*) filter (where status = 'failed') as failed_runs, sum(case when e % 5 <> 0 then e % 3 else 0 end)::bigint as total_retries, count(*) filter (where e % 6 <> 0 and e % 10 = 1) as total_re_auths,
        sum(coalesce(fetched, 0))::bigint as total_transactions_fetched, sum(e % 4)::bigint as total_transactions_skipped, sum(e % 2)::bigint as total_pending_skipped, count(*) filter (where e % 8 = 0) as resumed_runs,
        sum(e % 3)::bigint as total_duplicates_skipped, sum(e % 13)::bigint as total_unchanged, sum(e % 7)::bigint as total_updated, count(*) filter (where e % 16 = 0) as checkpoint_recoveries,
        any_value(last_run_at) as last_run_at, any_value(last_run_duration_ms) as last_run_duration_ms, any_value(last_run_status) as last_run_status, any_value(last_run_provider) as last_run_provider from runs, l""",
    "last_run": f"with {_RUNS} select {_LAST} from runs order by e desc limit 1",
    "run_duration": "select event_id as record_seq, (epoch_us(date_trunc('second', ts)) // 1000 + event_id % 100 * 1000 - epoch_us(ts) // 1000)::bigint as ms from events",
    "run_summary": f"""with {_CLASSIFIED}, a as (select provider_account_id, {_COUNTERS} from classified group by 1) select count(*) as total_accounts, count(*) filter (where provider_account_id <> 'acct_0') as succeeded,
        count(*) filter (where provider_account_id = 'acct_0') as failed, sum(exported)::bigint as total_transactions_exported, sum(considered)::bigint as total_transactions_considered from a""",
    "account_sums": f"with {_CLASSIFIED} select considered as transactions_fetched, created, updated, unchanged, exported from (select {_COUNTERS} from classified)",
    "account_results": f"with {_RUNS} select display_name, status, case when display_name = 'error' then 'boom' end as error, {_RESULT} from runs",
    "account_events": f"with {_RUNS} select {_RESULT} from runs",
    "event_text": f"""with {_RUNS}, named as (select *, coalesce(case when e % 5 <> 0 then display_name end, provider_account_id) as who from runs) select e as record_seq, case e % 13
        when 0 then '▶ ' || who || ' — starting (days back ' || case when e % 2 = 0 then (e % 30)::varchar else 'global' end || ')…'
        when 1 then '   ' || who || ' — CAL login requires a visible browser window. Keep it open until login completes.'
        when 2 then '   ' || who || case when e % 2 = 0 then ' — reused saved session.' else ' — logged in.' end
        when 3 then '   ' || who || ' — fetched ' || e || ' transaction(s)' || case when e % 2 > 0 then ', ' || e % 2 || ' pending skipped' else '' end || case when e % 4 > 0 then ', ' || e % 4 || ' extraction skip(s)' else '' end || '.'
        when 4 then '   ' || who || ' — ' || e % 12 || ' new, ' || e % 7 || ' updated, ' || e % 13 || ' unchanged, ' || e % 3 || ' duplicate(s).'
        when 5 then '   ' || who || case when e % 12 + e % 7 > 0 then ' — exported ' || (e % 12 + e % 7) || ' transaction(s)' || case when e % 3 = 0 then ' → out/f.json' else '' end || '.' else ' — nothing new to export.' end
        when 6 then '✔ ' || who || ' — done (' || status || ').'
        when 7 then '✖ ' || who || ' — boom'
        when 8 then '▶ Finance sync — evaluating ' || e || ' transaction(s) against the finance ledger…'
        when 9 then '✔ Finance sync — sent ' || e % 3 || ', already sent ' || e % 4 || ', skipped ' || e % 5 || ', failed ' || e % 2 || ' (of ' || e || ').'
        when 10 then '• Finance sync not attempted — ' || case when e % 2 = 0 then 'finance integration is disabled' else 'no finance API key is saved' end || '.'
        when 11 then '✖ Finance sync — boom' end as line from named""",
    "export_path": "select o_orderkey, 'out/cal' || case when o_custkey % 2 = 0 then '' else '_' || o_custkey end || '_' || strftime(o_orderdate, '%Y-%m-%d') || '.json' as path from orders",
    "warnings_concat": "select o_orderkey, case when o_orderkey % 3 = 0 then 'earlier;' else '' end || o_orderpriority as warnings from orders",
    "landing_scan": f"with {_CLASSIFIED} select seq, provider_account_id, local_dedup_status from classified",
    "account_union": f"with {_CLASSIFIED} select seq, provider_account_id, local_dedup_status from classified",
    "capture_stream": f"with {_KEYED} select seq, dedup_key, 'new' as local_dedup_status from keyed",
    "capture_final": f"with {_FINAL} select seq, dedup_key, local_dedup_status from classified",
    "capture_pending": "select count(*) filter (where o_orderkey % 13 = 0) as pending_skipped from orders",
    "run_accounts": """select * exclude (step) replace (skipped::bigint as skipped) from (values ('cal', 1, 'Cal', 'success', 0), ('other', 2, 'Other', 'partial', 1), ('broken', 0, 'Broken', 'failed', 0)) v(provider, step, display_name, status, skipped),
        lateral (select 'default' as provider_account_id, count(*) filter (where v.step > 0 and o_orderkey % greatest(v.step, 1) = 0 and o_orderkey % 13 <> 0) as transactions_fetched,
            count(*) filter (where v.step > 0 and o_orderkey % greatest(v.step, 1) = 0 and o_orderkey % 13 = 0) as pending_skipped from orders) c, lateral (select c.transactions_fetched as created, c.transactions_fetched as exported, c.transactions_fetched as considered) z""",
    "run_considered": f"""with {_HASHED}, own as (select *, count(*) over (partition by p, fp) as c from (
        select *, unnest(case when seq % 2 = 0 then ['CAL', 'other'] else ['CAL'] end) as p from hashed where seq % 13 <> 0))
        select p as provider, 'default' as provider_account_id, case p when 'CAL' then 'Cal' else 'Other' end as provider_display_name, count(*) as rows, count(*) - count(distinct fp) as repeats from own group by all""",
    "fetch_succeeded": "select bool_or(event_type <> 'error') as fetch_succeeded, false as of_failed from events",
    "sync_ok": "select event_id, event_id % 3 <> 0 and (event_id % 4 = 0 or event_id % 2 = 0) as ok from events",
    "report_name": "select n_nationkey, 'finance-sync-' || n_name as name from nation",
    "row_recognizer": "select o_orderkey, o_orderkey % 7 = 5 as is_row from orders",
    "failure_after_success": f"""with {_LEDGER} select provider, provider_account_id, dedup_key, finance_status, case k when 3 then 'api_error' else 'already_sent_successfully' end as reason, case k when 3 then 500 else api_status end as api_status,
        2 as attempts, case when k <> 3 then '2025-12-01 00:00:00' end as sent_at, '2026-01-02 03:04:05' as last_attempt_at from ledger""",
    "ledger_load": "select 'cal' as provider, c_custkey::varchar as provider_account_id, 'k' || c_custkey as dedup_key, 'sent' as finance_status, 'h' || c_custkey as content_hash, 201 as api_status, '2026-01-02 03:04:05' as sent_at, 2 as attempts from customer where c_custkey % 4 <> 0",
    "state_versions": f"with {_SEEN} select provider, provider_account_id, dedup_key, content_hash, '2025-12-01 00:00:00' as last_seen_at from seen",
    "ledger_versions": f"with {_LEDGER} select provider, provider_account_id, dedup_key, finance_status, api_status, finance_transaction_id, 1 as attempts from ledger",
    "statement_source": f"""with {_RAW} select seq, ts_raw as transaction_ts_raw, null::varchar as warning from raw where {_date('ts_raw')} >= strftime(date '1996-06-15' - 700, '%Y-%m-%d') and seq >= 1000 and seq % 9 <> 0
        union all select null, null, 'row skipped: {{broken ' || seq from raw where seq % 9 = 0""",
    "table_source": f"with {_RAW} select seq, ts_raw as transaction_ts_raw from raw where {_date('ts_raw')} >= strftime(date '1996-06-15' - 700, '%Y-%m-%d')",
    "export_roundtrip": f"with {_CLASSIFIED} select provider, provider_account_id, '2026-01-02' as export_date, count(*) as rows, count(distinct dedup_key) as keys from classified where kind <> 'unchanged' group by 1, 2",
    "audit_report": f"""with {_FINISHED} select finance_status as "financeStatus", reason, count(*) as rows, min(dedup_key) as first_key from finished group by 1, 2""",
    "checkpoint_roundtrip": f"with {_RAW} select provider_account_id as account, (max(seq) + 1)::bigint as next_index, count(*) as rows, sum(seq)::bigint as seqs, 'up to ' || max(seq) as warnings from raw where provider_account_id <> 'acct_2' group by 1",
    "array_splits": f"""with {_TXN} select seq, merchant_name || '"],[{{' || chr(92) as merchant_name, amount, status from txn""",
    "json_scan": f"with {_TXN} select seq, merchant_name, amount, status from txn",
    "valid_rows": f"""with {_RAW}, r as (select seq, seq % 9 = 0 as bad, {_date('ts_raw')} >= strftime(date '1996-06-15' - 700, '%Y-%m-%d') as recent from raw)
        select count(*) filter (where recent and not bad) as rows, sum(seq) filter (where recent and not bad)::bigint as seqs, count(*) filter (where bad) as warnings from r""",
    "journal_once": """select s_name as dedup_key, case when s_suppkey % 4 = 0 then 'failed' else 'sent' end as finance_status, case when s_suppkey % 4 = 0 then 'api_validation_failed' else 'already_sent_successfully' end as reason,
        case when s_suppkey % 4 = 0 then 422 else 201 end as api_status, case when s_suppkey % 4 <> 0 then 'id' || s_suppkey end as finance_transaction_id, 1 as attempts from supplier""",
    "account_sanitize": f"""with {_DESCRIBED}
        select c_nationkey, seq, provider, account as provider_account_id, display_name, enabled, row_number() over (partition by c_nationkey order by marked desc, seq) = 1 as is_default, days_back::bigint as days_back,
            null::varchar as credential_key, username_env, password_env, false as leaks from described""",
    "credentials_resolve": f"""with {_DESCRIBED}
        select seq, case when seq % 6 = 0 then 'own' || seq else coalesce(u.n_name, '') end as username, coalesce(lower(p.n_name), '') as password
        from described left join nation u on username_env = 'USER_' || u.n_nationkey and u.n_nationkey <> 4 left join nation p on password_env = 'PASS_' || p.n_nationkey and p.n_nationkey <> 4""",
    "account_load": f"""with {_DESCRIBED}, listed as (select * from described where seq % 10 not in (0, 2))
        select seq * 10 as seq, provider, account as provider_account_id, case when display_name = '' then 'CAL (default)' else display_name end as display_name, enabled, marked as is_default, days_back::int as days_back from listed
        union all select seq * 10 + 1, 'max', 'second', 'MAX (second)', true, seq % 2 = 0, null from listed""",
    "settings_roundtrip": f"""with {_DESCRIBED}, b as (select *, seq % 10 in (0, 1, 2) as bare, seq % 10 not in (0, 2) as listed, not marked and seq % 2 = 0 as second, seq % 500 - 50 as days from described)
        select seq::varchar as name, case when seq % 10 = 2 then 9 when not bare and days between 1 and 365 then days end::int as days_back, not bare and seq % 3 = 0 as finance_enabled,
            case when bare then '' else 'https://x/' || seq end as api_url, 'finance-default' as finance_credential_key, case when listed then 2 else 0 end as accounts,
            case when listed then case when second then 'second' else account end end as default_account, case when listed and not second then username_env end as username_env, false as leaks from b""",
    "registry_resolve": "select c_custkey, case when lower(c_mktsegment) in ('building', 'machinery', 'tables') then lower(c_mktsegment) end as source from customer",
    "post_requests": f"""with {_KEYED} select seq, 'expense' as type, charge_amount as amount, transaction_date as date, merchant_name as description, account_id as payment_source_name, currency,
        case when amount > 0 then amount else charge_amount end as original_amount, dedup_key as external_id from keyed where status = 'completed' and charge_amount > 0""",
    "post_messages": """with b as (select doc_id, replace(replace(replace(coalesce(text, ''), 'token', '[REDACTED]'), 'the', '[REDACTED]'), 'que', '[REDACTED]') as shown from documents),
        c as (select *, case when length(shown) <= 200 then shown else left(shown, 200) || '…[truncated]' end as short from b)
        select doc_id, case when doc_id % 5 = 0 then 'Finance request failed: ' || shown else 'HTTP ' || case when doc_id % 5 = 1 then 422 else 500 end || case when short = '' then '' else ' — ' || short end end as message from c""",
    "one_run_at_a_time": """with q as (select c_name as dedup_key, row_number() over (order by c_custkey) as n, count(*) over () // 2 as half from customer where c_acctbal > 0)
        select dedup_key, 'sent' as finance_status, case when n <= half then 'first' else 'second' end as sent_by from q""",
    "send_all_or_stop": f"""with {_TXN}, t as (select count(*) as total, count(*) filter (where status = 'completed' and charge_amount > 0) as qualifying from txn)
        select total, qualifying, 0::bigint as dry_sent, qualifying as sent, least(qualifying, 5) as calls, qualifying >= 5 as stopped from t""",
    "sync_not_attempted": """with g(gate) as (values ('run_mode_fetch_only'), ('finance_disabled'), ('missing_api_url'), ('missing_api_key'), ('fetch_failed'))
        select gate, false as executed, gate as reason, case when gate <> 'run_mode_fetch_only' then n end as not_attempted, gate <> 'run_mode_fetch_only' as reported from g, (select count(*) as n from orders)""",
}
