"""The registered queries of the training-data operators and their SQL, where SQL can express them.

Each query applies its operator with production parameters to the whole of its table. The operators
return texts, spans and lists; the digest columns that a query returns are derived from those here.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, conversation_repair, embedding_dedup, exact_dedup, gru_lm, html_extract, language_id, ngram_join, packing, quality_cnn, secret_scan, sentencepiece_bpe, treap_search
from .common import crc_mod, table

TOKENIZER = public_tokenizers.path("piece_bpe_32k.model")
#: Folds of the labelled rows: a row whose crc32(doc_id) modulo FOLDS is HELD_OUT is never learned from.
FOLDS, HELD_OUT = 4, 2
#: From this score on a document counts as good.
GOOD = 0.7


def op1_sentencepiece(spark: SparkSession, sf_dir: str, model_file: str = TOKENIZER) -> DataFrame:
    with open(model_file, "rb") as f:
        model = f.read()
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ids = sentencepiece_bpe.encode(docs, model).select("doc_id", "ids")
    both = sentencepiece_bpe.decode(ids, model)
    digest = F.sha2(F.array_join(F.transform("ids", lambda i: i.cast("string")), " "), 256)
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest.alias("ids_sha256"), F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_extract.extract(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.classes_of(table(spark, sf_dir, "documents"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.assign(table(spark, sf_dir, "documents"))


OP5_SQL = """
with n as (
    select doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) as text_sha256
    from documents
), g as (select text_sha256, max(doc_id) as keep_id, count(*) as group_size from n group by text_sha256)
select n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id as kept, n.text_sha256
from n join g using (text_sha256)
"""


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", (crc_mod(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"))
    samples = language_id.learn(docs.where("not held_out"))
    return language_id.predict(docs.select("doc_id", "text", "held_out"), samples).select("doc_id", "held_out", "lang_pred", "score")


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn int, role string, text string")
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("int"), "role", "text").unionByName(extra)
    chats = chat_format.format_chats(turns)
    back = chats.select("*", chat_format.read_back(F.col("formatted")).alias("back"))
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: chat_format.unescape(s["text"])), "")
    plain = F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select("conv_id", F.size("back").cast("long").alias("n_turns"), F.sha2(plain, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


OP7_SQL = r"""
with t as (
    select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
    union all
    select * from (values (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')) as x(conv_id, turn, role, text)
), e as (
    select *,
        length(replace(replace(replace(replace(role, '\', '\b'), '#', '\h'), '<', '\l'), ':', '\c')) as role_n,
        length(replace(replace(replace(replace(text, '\', '\b'), '#', '\h'), '<', '\l'), ':', '\c')) as text_n
    from t
)
select conv_id, count(*) as n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
    cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
    sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
    cast(sum(length('### ') + role_n + length(': ') + text_n + length('</turn>' || chr(10))) as bigint) as formatted_chars
from e group by conv_id
"""


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gru_lm.score_documents(table(spark, sf_dir, "documents"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (crc_mod(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"))
    labels = table(spark, sf_dir, "labels").where(crc_mod(F.col("doc_id"), FOLDS) != HELD_OUT)
    network = quality_cnn.learn(docs, labels)
    scored = quality_cnn.score(docs, network)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= GOOD).cast("int").alias("predicted"))


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op11_ranked_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return treap_search.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP11_SQL = r"""
with d as (
    select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
    from documents
), t as (select doc_id, term, count(*) as tf from d group by doc_id, term
), n as (select doc_id, cast(sum(tf) as bigint) as n from t group by doc_id
), c as (select count(*) as docs, cast(sum(n) as bigint) as length from n
), q as (
    select item_id, term, count(*) as times from (
        select item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
        from benchmark
    ) group by item_id, term
), w as (
    select term, cast(floor(1000 * ln((2 * any_value(docs) + 2)::double / (2 * count(*) + 1)::double)) as bigint) as w
    from t cross join c where term in (select term from q) group by term
), s as (
    select item_id, t.doc_id, cast(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // length)))) as bigint) as score
    from q join t using (term) join w using (term) join n on n.doc_id = t.doc_id cross join c
    group by item_id, t.doc_id
), r as (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from s where score > 0)
select item_id, cast(rank as integer) as rank, doc_id, score from r where rank <= 20
"""


def op12_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secret_scan.scan(docs, secret_scan.learn(docs))
    base = F.filter("spans", lambda s: s["kind"] != "format")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of_kind = lambda kind: F.filter("spans", lambda s: s["kind"] == kind)
    counts = [F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in secret_scan.KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def damaged(conversations: DataFrame) -> DataFrame:
    """conversations with a share of rows dropped, emptied, truncated, repeated or given the role user; a null in any column is one space."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select("conv_id", "turn", said("role").alias("role"), said("text").alias("text"), (F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20).alias("how")).where("how <> 0")
    text = F.when(F.col("how") == 1, "").when(F.col("how") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.array_repeat(F.lit(0), F.when(F.col("how") == 3, 2).otherwise(1))
    return rows.select("conv_id", "turn", F.when(F.col("how") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    found, blocks = conversation_repair.repair(damaged(conversations))
    digests = conversation_repair.digests(blocks)
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    every = conversations.select("conv_id").distinct()
    one = lambda df, name: df.withColumnRenamed("conv_id", name)
    joined = every.join(one(found, "found_id"), F.col("conv_id").eqNullSafe(F.col("found_id")), "left").join(one(digests, "digest_id"), F.col("conv_id").eqNullSafe(F.col("digest_id")), "left")
    return joined.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def _op13_sql() -> str:
    """Costs and audits as strings, a cost of twelve digits before its audit, so that the least string is the best one; ~ is out of reach."""
    add = lambda v, cost, edits: f"case when {v} = '~' then '~' else lpad(cast(cast(substr({v}, 1, 12) as bigint) + {cost} as varchar), 12, '0') || substr({v}, 13) || '{edits}' end"
    one, two = (lambda v: add(v, 3, "I")), (lambda v: add(v, 6, "II"))
    closed = f"v0, vs, least(vu, {one('v0')}, {one('vs')}, {one('va')}) as vu, least(va, {one('vu')}, {two('v0')}, {two('vs')}) as va"
    stays = "(case when letter in ('S', 'U', 'A', 'O') then 3 else 0 end)"
    keep = lambda letter, v: f"case when lower(letter) = '{letter}' then {add(v, stays, 'K')} else '~' end"
    rerole = lambda v: f"case when letter <> 'd' then {add(v, f'3 + {stays}', 'R')} else '~' end"
    to_user = ", ".join(f"{keep('u', v)}, {rerole(v)}" for v in ("v0", "vs", "va"))
    gone = {v: add(v, 4, "D") for v in ("v0", "vs", "vu", "va")}
    return rf"""
with recursive bits(i, c, k) as (
    select cast(range as bigint), cast(range as bigint), 0 from range(256)
    union all select i, case when c % 2 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, k + 1 from bits where k < 8
), tab as (select list(c order by i) as tab from bits where k = 8
), h as (
    select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
        xor(list_reduce(list_transform(range(1, length(key) + 1), lambda j: cast(ascii(substr(key, j, 1)) as bigint)), lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1]), cast(4294967295 as bigint)), 4294967295) % 20 as how
    from (select *, coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ') as key from conversations), tab
), d as (
    select conv_id, turn, case how when 4 then 'user' else role end as role,
        case how when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text, unnest(range(case when how = 3 then 2 else 1 end)) as copy
    from h where how <> 0
), r as (select *, row_number() over (partition by conv_id order by turn nulls first, role, sha256(text), copy) as pos from d
), e as (
    select *, row_number() over (partition by conv_id, role, text order by pos) as seen,
        coalesce(lag(role[:1]) over (partition by conv_id order by pos) || role[:1] not in ('su', 'ua', 'au'), false) as illegal
    from r
), f as (
    select *, case when fault in ('blank', 'duplicate') then 'd' when fault is not null then upper(role_letter) else role_letter end as letter from (
        select *, case when role[:1] in ('s', 'u', 'a') then role[:1] else 'o' end as role_letter,
            case when not regexp_matches(text, '[^ 	-
]') then 'blank' when seen > 1 then 'duplicate'
                when regexp_extract(text, '([^ 	-
])[ 	-
]*\z', 1) not in ('.', '!', '?') then 'truncated' end as fault
        from e)
), g as (
    select conv_id, count(*) as n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (where fault = 'blank') as blank,
        count(*) filter (where fault = 'duplicate') as duplicate, count(*) filter (where fault = 'truncated') as truncated, count(*) filter (where illegal) as illegal
    from f group by conv_id
), dp(conv_id, pos, v0, vs, vu, va) as (
    select conv_id, cast(0 as bigint), '000000000000', '~', '~', '~' from g
    union all
    select conv_id, pos, {gone['v0']}, least({gone['vs']}, {keep('s', 'v0')}), least({gone['vu']}, {to_user}), least({gone['va']}, {keep('a', 'vu')}, {rerole('vu')})
    from (select dp.conv_id, f.pos, f.letter, {closed} from dp join f on f.conv_id is not distinct from dp.conv_id and f.pos = dp.pos + 1)
), b as (
    select conv_id, cast(substr(best, 1, 12) as bigint) as cost, substr(best, 13) as audit
    from (select conv_id, least(v0, va) as best from (select dp.conv_id, {closed} from dp join g on g.conv_id is not distinct from dp.conv_id and g.n = dp.pos))
), rp(conv_id, audit, k, pos, state, lines) as (
    select conv_id, audit, 1, cast(0 as bigint), '0', cast([] as varchar[]) from b
    union all
    select conv_id, audit, k + 1, next, case edit when 'D' then state else wanted[:1] end, case edit when 'D' then lines else list_append(lines, wanted || ':' || text) end
    from (
        select rp.conv_id, audit, k, state, lines, substr(audit, k, 1) as edit, rp.pos + (case substr(audit, k, 1) when 'I' then 0 else 1 end) as next,
            case when substr(audit, k, 1) = 'K' then f.role when state = 'u' then 'assistant' else 'user' end as wanted, case when substr(audit, k, 1) = 'I' then '' else f.text end as text
        from rp left join f on f.conv_id is not distinct from rp.conv_id and f.pos = rp.pos + 1 where k <= length(audit)
    )
), t as (select conv_id, sha256(coalesce(array_to_string(lines, chr(10)), '')) as repaired_sha256 from rp where k = length(audit) + 1
)
select c.conv_id, cast(coalesce(gaps, 0) as bigint) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal,
    coalesce(cost, 0) as cost, coalesce(audit, '') as audit, coalesce(repaired_sha256, sha256('')) as repaired_sha256
from (select distinct conv_id from conversations) c left join g on g.conv_id is not distinct from c.conv_id left join b on b.conv_id is not distinct from c.conv_id left join t on t.conv_id is not distinct from c.conv_id
"""


OP13_SQL = _op13_sql()


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_sentencepiece, op2_html_extraction, op3_ngram_jaccard_join, op4_best_fit_packing, op5_exact_dedup, op6_language_id, op7_chat_formatting, op8_lm_scoring, op9_quality_classifier, op10_embedding_near_dedup, op11_ranked_lexical_search, op12_secret_scans, op13_conversation_repair)
}
ORACLE_SQL: dict[str, str] = {"op5_exact_dedup": OP5_SQL, "op7_chat_formatting": OP7_SQL, "op11_ranked_lexical_search": OP11_SQL, "op13_conversation_repair": OP13_SQL}
