"""The registered queries of this subpackage: each applies an operator to its whole table."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.llm.common import bound_batches, ship, table

#: The rules of op7 (host, path, verdict).
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weirflow.llm.mixing import plan_mixture

    plan = plan_mixture(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weirflow.llm.fingerprints import compare

    return compare(table(spark, sf_dir, "documents"))


def op3_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weirflow.llm.neardup import components

    return components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weirflow.llm.sharding import interleave

    placed = interleave(table(spark, sf_dir, "documents"), shards=8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weirflow.llm.quality import learn, score

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = learn(docs, table(spark, sf_dir, "labels"), ~_held_out(), "quality", at=0.3)
    scored = score(docs, model)
    return scored.select("doc_id", _held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from weirflow.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), size=4096, end_id=2)


def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weirflow.llm.urls import judge

    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return judge(table(spark, sf_dir, "pages"), rules).drop("url")


def op8_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weirflow.llm.passages import strip

    return strip(table(spark, sf_dir, "documents"), least=100, texts=False)


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weirflow.llm.langid import identify, learn

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = learn(docs, ~_held_out())
    return identify(docs.select("doc_id", "text"), model).select("doc_id", _held_out().alias("held_out"), "lang_pred", "score")


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weirflow.llm.topk import search

    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10, scale=1024)


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weirflow.llm.collocations import mine

    return mine(table(spark, sf_dir, "documents"), longest=3, least=10, top=2000, share=50)


def op12_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weirflow.llm.licenses import scan

    found = scan(table(spark, sf_dir, "documents"))
    joined = [F.array_join(c, ",").alias(c) for c in ("base_labels", "labels")]
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", *joined, "score")


def op13_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weirflow.llm.trie import prefix_trie, rebuild, turns_of

    conv = F.col("conv_id")
    borrowed = F.crc32(conv.cast("string").cast("binary")) % 4
    turns, convs = rebuild(turns_of(table(spark, sf_dir, "conversations")), conv - conv % 20, borrowed, 3)
    return prefix_trie(turns, ["phase", "turn"], convs).drop("fp")


def _bounded(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @functools.wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        bound_batches(spark)
        ship(spark)
        return f(spark, sf_dir)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_mixing, op2_fingerprints, op3_neardup, op4_sharding, op5_quality, op6_packing, op7_urls, op8_passages, op9_langid, op10_topk, op11_collocations, op12_licenses, op13_trie)
    return {f.__name__: _bounded(f) for f in own}


#: Words of a text, as DuckDB counts them: pieces between runs of ASCII white space.
_SIZE = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"

ORACLE_SQL = {
    "op1_mixing": f"""
        with sized as (select doc_id, source, {_SIZE}::bigint as size, coalesce(md5(text), '~') as hash from documents),
        totals as (select source, sum(size)::bigint as source_size from sized group by source),
        ranked as (select *, ([3.0, 1.0, 2.0])[((row_number() over (order by source is null, source) - 1) % 3 + 1)::int]::double as w from totals),
        level as (
            select max(l) as level from (
                select (1.5 * (select sum(source_size) from ranked) - coalesce((select sum(2.0 * b.source_size) from ranked b where 2.0 * b.source_size / b.w < 2.0 * a.source_size / a.w), 0))::double
                    / ((select sum(w) from ranked) - coalesce((select sum(b.w) from ranked b where 2.0 * b.source_size / b.w < 2.0 * a.source_size / a.w), 0))::double as l
                from ranked a)),
        goals as (select source, source_size, least(2.0 * source_size, w * level)::double as target from ranked, level),
        rated as (
            select doc_id, size, source_size, target, case when source_size > 0 then target / source_size else 0.0::double end as rate,
                ('0x' || substr(md5('17:' || coalesce(doc_id::varchar, '~') || ':' || hash), 1, 13))::bigint::double / 4503599627370496.0::double as draw
            from sized join goals on sized.source is not distinct from goals.source)
        select doc_id, size, source_size, target, size * copies as taken, copies
        from (select *, (floor(rate) + (draw < rate - floor(rate))::int)::bigint as copies from rated)""",
    "op7_urls": """
        with p as (
            select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) end as rest from pages),
        q as (
            select page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
                coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') as path from p),
        r(h, p, v) as (values ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block'))
        select page_id, host, path,
            (select h || p from r where (host = h or ends_with(host, '.' || h)) and starts_with(path, p) order by length(h || p) desc, length(h) desc limit 1) as rule,
            coalesce((select v from r where (host = h or ends_with(host, '.' || h)) and starts_with(path, p) order by length(h || p) desc, length(h) desc limit 1), 'allow') as verdict
        from q""",
    "op11_collocations": r"""
        with texts as (select coalesce(lang, 'und') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
        pieces as (select lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) as piece from texts),
        worded as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as ws from pieces),
        starts as (select lang, ws, size, unnest(range(1, greatest(len(ws) - size + 2, 1))) as i from worded, (values (1), (2), (3)) s(size)),
        counted as (select lang, size, array_to_string(ws[i:i + size - 1], ' ') as phrase, count(*) as f from starts group by all),
        totals as (select lang, sum(f) as n from counted where size = 1 group by lang),
        candidates as (select lang, size, phrase, string_split(phrase, ' ') as ws, f as a from counted where size > 1 and f >= 10),
        cuts as (select *, unnest(range(1, size)) as k from candidates),
        scored as (
            select c.lang, c.phrase, c.a, k, l.f as l, r.f as r, (1000000::hugeint * c.a * c.a) // (l.f::hugeint * r.f) as score
            from cuts c join counted l on l.lang = c.lang and l.phrase = array_to_string(ws[1:k], ' ') join counted r on r.lang = c.lang and r.phrase = array_to_string(ws[k + 1:], ' ')),
        best as (select * from scored qualify row_number() over (partition by lang, phrase order by score, k) = 1),
        longer as (
            select lang, phrase, max(a) as longer from (select lang, a, unnest([array_to_string(ws[1:2], ' '), array_to_string(ws[2:3], ' ')]) as phrase from candidates where size = 3) group by all),
        kept as (select best.* from best left join longer using (lang, phrase) where longer is null or 100 * longer < 50 * a),
        ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept)
        select lang, rank, phrase, a, l, r, n::bigint as n, score::bigint as score from ranked join totals using (lang) where rank <= 2000""",
    "op13_trie": r"""
        with turns as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null),
        own as (
            select conv_id, digest, words, row_number() over (partition by conv_id order by turn nulls first, digest) - 1 as i
            from (select conv_id, turn, sha256(length(role)::varchar || ':' || role || text) as digest, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))::bigint as words from turns)),
        conv as (
            select conv_id, conv_id - conv_id % 20 as base, xor(list_reduce(list_concat([4294967295::bigint], list_transform(string_split(conv_id::varchar, ''), lambda ch: ascii(ch)::bigint)),
                lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)), lambda x, y: xor(x >> 1, 3988292384::bigint * (x & 1)))), 4294967295::bigint) % 4 as h
            from (select distinct conv_id from turns)),
        rebuilt as (
            select conv.conv_id, 0 as phase, i, digest, words from conv join own on own.conv_id = base where i < h
            union all select conv_id, 1 as phase, i, digest, words from conv join own using (conv_id) where i >= h),
        paths as (
            select conv_id, 0 as depth, '' as path, 0 as words from conv
            union all select conv_id, row_number() over w, string_agg('/' || digest, '') over w, words from rebuilt window w as (partition by conv_id order by phase, i)),
        nodes as (select depth, path, min(conv_id) as conv_id, count(*) as n_convs, any_value(words) as words, left(path, greatest(length(path) - 65, 0)) as parent from paths group by depth, path),
        ends as (select path, sha256(string_agg(conv_id::varchar, ',' order by conv_id)) as ends_sha256 from (select conv_id, arg_max(path, depth) as path from paths group by conv_id) group by path),
        children as (select parent as path, count(*) as n_children from nodes where depth > 0 group by parent),
        valued as (select nodes.*, coalesce(n_children, 0) as n_children from nodes left join children using (path)),
        subtrees as (
            select paths.path, count(*) filter (n_children = 0) as n_leaves, sum((n_convs - 1) * valued.words) as saved_tokens
            from valued join paths on paths.conv_id = valued.conv_id and paths.depth <= valued.depth group by paths.path)
        select n.conv_id, n.depth::bigint as depth, p.conv_id as parent_conv_id, n.n_convs::bigint as n_convs, n.n_children::bigint as n_children, n_leaves::bigint as n_leaves,
            saved_tokens::bigint as saved_tokens, coalesce(ends_sha256, sha256('')) as ends_sha256
        from valued n left join nodes p on n.depth > 0 and p.path = n.parent left join ends e on e.path = n.path join subtrees s on s.path = n.path""",
    "op10_topk": """
        with v as (
            select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) as e from embeddings
            where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        c as (select vec_id, generate_subscripts(e, 1) as term, unnest(e) as weight from v),
        s as (
            select q.vec_id as query_id, c.vec_id, sum(q.weight * c.weight)::bigint as score
            from c q join c on q.term = c.term and q.vec_id <> c.vec_id where q.vec_id % 100 = 0 group by all)
        select query_id, rank::int as rank, vec_id, score
        from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s) where rank <= 10""",
}


def _license_sql() -> str:
    from weirflow.llm.licenses import BETWEEN, NOTICES, PHRASES

    given = ", ".join(f"({t}, '{label}', '{text}', {t < len(PHRASES)})" for t, (label, text) in enumerate([*PHRASES, *NOTICES]))
    ws = f"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{BETWEEN}'), lambda x: x <> '')"
    return f"""
        with given(t, label, text, whole) as (values {given}),
        template as (select t, label, whole, {ws} as ws from given),
        sized as (select *, case when len(ws) >= 4 then 4 else 2 end as size from template),
        placed as (select *, unnest(range(len(ws) - size + 1)) as q from sized),
        grams as (select t, label, whole, size, len(ws) - size + 1 as n_grams, q, array_to_string(ws[q + 1:q + size], ' ') as gram from placed),
        docs as (select row_number() over () as r, doc_id, {ws} as ws from documents),
        starts as (select r, ws, size, unnest(range(greatest(len(ws) - size + 1, 0))) as p from docs, (values (2), (4)) s(size)),
        hits as (select r, t, label, whole, n_grams, q, p - q as d from (select r, size, p, array_to_string(ws[p + 1:p + size], ' ') as gram from starts) join grams using (size, gram)),
        diagonals as (select distinct r, t, whole, d from hits),
        cut as (select *, case when whole or coalesce(d - lag(d) over (partition by r, t order by d) > 3, true) then 1 else 0 end as apart from diagonals),
        runs as (select r, t, d, sum(apart) over (partition by r, t order by d rows unbounded preceding) as span from cut),
        spans as (select r, t, label, whole, min(d) as d, count(distinct q)::double / n_grams as covered from hits join runs using (r, t, d) group by r, t, label, whole, n_grams, span),
        good as (select *, whole and covered = 1 as place from spans where covered = 1 or not whole),
        found as (
            select r, count(*) filter (place) as n_base, min(d) filter (place) as first_word, max(d) filter (place) as last_word,
                list_sort(list_distinct(list(label) filter (place))) as base_labels, list_sort(list_distinct(list(label) filter (place or covered >= 0.6))) as labels, max(covered) as score
            from good group by r)
        select doc_id, len(ws)::bigint as n_words, coalesce(n_base, 0)::bigint as n_base, first_word::bigint as first_word, last_word::bigint as last_word,
            coalesce(array_to_string(base_labels, ','), '') as base_labels, coalesce(array_to_string(labels, ','), '') as labels, coalesce(score, 0)::double as score
        from docs left join found using (r)"""


ORACLE_SQL["op12_licenses"] = _license_sql()


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE_SQL)
