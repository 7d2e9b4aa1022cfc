"""The queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, chat, collocations, decontamination, exact_dedup, jaccard_join, lexical_search, lm_score, packing, quality, suffix_dedup, url_filter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_chat_format(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = "</s>[INST] ok [/INST]"
    own = spark.range(1).selectExpr("explode(array('user', 'assistant')) as role").selectExpr("cast(-1 as bigint) conv_id", "cast(if(role = 'user', 0, 1) as bigint) turn", "role", f"'{tricky}' text")
    done = chat.format_chats(turns.unionByName(own))
    read = done.select("conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("t"), F.array_join(chat.read_loss(F.col("formatted"), F.col("loss_spans")), "").alias("loss"))
    lines = F.array_join(F.transform("t", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return read.select("conv_id", F.size("t").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


def op2_ann(spark, sf_dir):
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op3_suffix_dedup(spark, sf_dir):
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op4_jaccard_join(spark, sf_dir):
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"), words=3, num=90, den=100)


def op5_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = quality.fit(docs, table(spark, sf_dir, "labels").where(~held))
    scored = quality.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held.alias("held_out"), "score", "predicted")


def op6_vector_packing(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


RULES = "values ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block') as rules(host, path, verdict)"


def op7_url_rules(spark, sf_dir):
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), spark.sql(f"select * from {RULES}"))


def op8_lm_score(spark, sf_dir):
    held = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    scored = lm_score.score_texts(table(spark, sf_dir, "documents"), ~held)
    return scored.withColumn("held_out", ~F.col("trained")).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op9_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op10_byte_bpe(spark, sf_dir):
    return bpe.bpe_round_trip(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_multi_50k.tiktoken"))


def op11_lexical_search(spark, sf_dir):
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_decontamination(spark, sf_dir):
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_collocations(spark, sf_dir):
    return collocations.collocations(table(spark, sf_dir, "documents"))


def queries():
    ops = (op1_chat_format, op2_ann, op3_suffix_dedup, op4_jaccard_join, op5_quality, op6_vector_packing, op7_url_rules, op8_lm_score, op9_exact_dedup, op10_byte_bpe)
    return {f.__name__: f for f in (*ops, op11_lexical_search, op12_decontamination, op13_collocations)}


SQL = {
    "op7_url_rules": """
        with p as (select page_id,
            translate(case when strpos(url, '://') > 0 then regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*') else '' end, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
            case when strpos(url, '://') > 0 then regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) else '' end as path
          from pages),
        r(h, q, v) as (values ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
        m as (select page_id, host, path, arg_max(h || q, length(h || q)) as rule, arg_max(v, length(h || q)) as v
          from p join r on (host = h or ends_with(host, '.' || h)) and starts_with(path, q) group by 1, 2, 3)
        select p.page_id, p.host, p.path, m.rule, coalesce(m.v, 'allow') as verdict
        from p left join m on p.page_id = m.page_id and p.host = m.host and p.path = m.path""",
    "op9_exact_dedup": """
        select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size,
          doc_id = max(doc_id) over w as kept, sha256(coalesce(text, '')) as text_sha256
        from documents window w as (partition by coalesce(text, ''))""",
    "op11_lexical_search": r"""
        with lowered as (select row_number() over () as r, doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents),
        t as (select r, doc_id, unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from lowered),
        size as (select r, doc_id, count(*) as n from t group by all),
        whole as (select count(*) as docs, sum(n)::bigint as words from size),
        asked as (select distinct item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark),
        tf as (select r, doc_id, term, count(*) as tf from t semi join asked using (term) group by all),
        df as (select term, count(*) as df from tf group by 1),
        gain as (select item_id, r, doc_id, floor(1000 * ln((2 * docs + 2)::double / (2 * df + 1)))::bigint * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * docs) // words))) as g
          from asked join tf using (term) join df using (term) join size using (r, doc_id), whole),
        scores as (select item_id, r, doc_id, sum(g)::bigint as score from gain group by all)
        select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id) as integer) as rank, doc_id, score from scores where score > 0
        qualify row_number() over (partition by item_id order by score desc, doc_id) <= 50""",
    "op12_decontamination": r"""
        with d as (select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
        i as (select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
        runs as (select distinct item_id, t, array_to_string(w[s:s + t - 1], ' ') as run from (select *, unnest(range(1, len(w) - t + 2)) as s from (select *, least(10, len(w)) as t from i where len(w) > 0))),
        places as (select r, t, s, array_to_string(w[s:s + t - 1], ' ') as run from (select r, w, t, unnest(range(1, len(w) - t + 2)) as s from d, (select distinct t from runs) where len(w) >= t)),
        hits as (select * from places semi join runs using (t, run)),
        under as (select r, count(distinct s + k) as n_hit from (select r, s, unnest(range(0, t)) as k from hits) group by 1),
        named as (select r, count(*) as n_items, sha256(string_agg(item, ',' order by item)) as items_sha256 from (select distinct r, cast(item_id as varchar) as item from hits join runs using (t, run)) group by 1)
        select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, coalesce(items_sha256, sha256('')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
        from d left join under using (r) left join named using (r)""",
    "op13_collocations": r"""
        with pieces as (select row_number() over () as r, lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) as piece
          from (select coalesce(lang, 'und') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents)),
        w as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from pieces),
        f as (select lang, k, phrase, count(*) as f from (select lang, k, array_to_string(w[s:s + k - 1], ' ') as phrase
          from (select *, unnest(range(1, len(w) - k + 2)) as s from w, range(1, 5) as ks(k) where len(w) >= k)) group by all having count(*) >= 30),
        n as (select lang, sum(len(w))::bigint as n from w group by 1),
        c as (select lang, k, phrase, f as a, string_split(phrase, ' ') as w from f where k > 1),
        longer as (select lang, phrase, max(a) as a from (
          select lang, a, array_to_string(w[s:s + m - 1], ' ') as phrase from (select *, unnest(range(1, k - m + 2)) as s from c, range(2, 4) as ms(m) where m < k)) group by 1, 2),
        kept as (select c.* from c left join longer using (lang, phrase) where longer.a is null or 100::hugeint * longer.a < 80::hugeint * c.a),
        cuts as (select kept.lang, kept.phrase, kept.a, kept.j, fl.f as l, fr.f as r, (2000000::hugeint * kept.a // (fl.f::hugeint + fr.f))::bigint as score
          from (select *, unnest(range(1, k)) as j from kept) as kept
          join f as fl on fl.lang = kept.lang and fl.phrase = array_to_string(kept.w[1:kept.j], ' ') join f as fr on fr.lang = kept.lang and fr.phrase = array_to_string(kept.w[kept.j + 1:kept.k], ' ')),
        worst as (select * from cuts qualify row_number() over (partition by lang, phrase order by score, j) = 1)
        select lang, row_number() over w as rank, phrase, a, l, r, n, score from worst join n using (lang)
        window w as (partition by lang order by score desc, a desc, encode(phrase)) qualify row_number() over w <= 2000""",
}


def oracle_sql():
    return dict(SQL)
