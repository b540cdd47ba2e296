"""Queries over texts that need a table or a trained model: lexicon joins, word segmentation, tagging."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lexicon as X
from ..operators import segment as S
from ..operators import sequence_model as M
from ..operators import tagging as T
from .catalog import query
from .fixtures import Views, with_views

_HITS = "h as (select p.ord, x.side, x.term from posts_doc p join lexicon x on contains(p.title, x.term))"


@query("lexicon_table_label", with_views("posts_doc", "lexicon") + f", {_HITS}, f as (select ord, bool_or(side = 'put') as hp, "
       "bool_or(side = 'call') as hc from h group by ord) select p.ord, case when hp and not hc then 'put' when hc and not hp then 'call' "
       "else 'unknown' end as label from posts_doc p left join f on f.ord = p.ord")
def q_lexicon_table_label(spark, d):
    v = Views(spark, d)
    return X.lexicon_label_join(v.posts_doc(), v.lexicon(), ["ord"]).select("ord", "label")


@query("lexicon_table_counts", with_views("posts_doc", "lexicon") + f", {_HITS}, n as (select side, term, count(*) as n from h group by 1, 2) "
       "select x.side, x.term, coalesce(n.n, 0) as n_titles from lexicon x left join n on n.side = x.side and n.term = x.term")
def q_lexicon_table_counts(spark, d):
    v = Views(spark, d)
    return X.lexicon_count_join(v.posts_doc(), v.lexicon(), ["ord"])


@query("lexicon_table_matches", with_views("posts_doc", "lexicon") + f", {_HITS} select ord, side, count(*) as n_terms, min(term) as first_term "
       "from h group by ord, side")
def q_lexicon_table_matches(spark, d):
    v = Views(spark, d)
    return X.lexicon_matches(v.posts_doc(), v.lexicon(), ["ord"]).groupBy("ord", "side").agg(
        F.count(F.lit(1)).alias("n_terms"), F.min("term").alias("first_term"))


# Part names without spaces, and a dictionary of their words with the counts they have, in which each word also
# stands with the first letter of the word after it, once: the longest word is often such a piece.
_RUNS = ("runs as (select distinct title from dense), dw as (select word, sum(freq) as n from pieces group by word), "
         "tot as (select sum(n) as t from dw), wt as (select word, cast(floor(ln(n / t) * 1000000 + 0.5) as bigint) as w from dw, tot), "
         "unk as (select cast(floor(ln(1 / t) * 1000000 + 0.5) as bigint) as w from tot), "
         "sub as (select title, i, l, substr(title, cast(i + 1 as integer), cast(l as integer)) as s from "
         "(select title, i, unnest(range(1, least(length(title) - i, (select max(length(word)) from dw)) + 1)) as l "
         "from (select title, unnest(range(0, length(title))) as i from runs))), "
         "e as (select title, i, list({'w': coalesce(wt.w, unk.w), 'l': l}) as es from sub left join wt on wt.word = sub.s, unk "
         "where wt.w is not null or l = 1 group by title, i), "
         "r as (select title, cast(length(title) as bigint) as i, [cast(0 as bigint)] as best, cast([] as bigint[]) as step from runs "
         "union all select title, i, list_prepend(m.v, best), list_prepend(m.l, step) from (select r.title, e.i, r.best, r.step, "
         "list_max(list_transform(e.es, lambda x: {'v': x.w + r.best[x.l], 'l': x.l})) as m from r join e on e.title = r.title and e.i = r.i - 1)), "
         "p as (select title, cast(0 as bigint) as upto, step, cast([] as varchar[]) as words from r where i = 0 "
         "union all select title, upto + step[upto + 1], step, list_append(words, substr(title, cast(upto + 1 as integer), cast(step[upto + 1] as integer))) "
         "from p where upto < length(title)) ")


@query("segment_best_path", with_views("dense", "pieces").replace("with ", "with recursive ", 1) + f", {_RUNS}"
       "select d.ord, cast(len(words) as bigint) as n_tokens, array_to_string(words, ' ') as tokens from dense d join p on p.title = d.title and upto = length(p.title)")
def q_segment_best_path(spark, d):
    v = Views(spark, d)
    t = S.segment_best_path(v.dense(), v.pieces())
    return t.select("ord", F.size("tokens").cast("long").alias("n_tokens"), F.array_join("tokens", " ").alias("tokens"))


# The events of a user as a sentence of event types; a tag by the size of the value.
_TAGS, _K = ["a", "n", "v"], 3
_LN = "cast(floor(ln((({c}) + 1.0) / (({t}) + 1.0 * ({k}))) * 1000000 + 0.5) as bigint)"
_HMM = ("pr as (select lag(tag) over (partition by sentence order by i) as a, tag as b from tagged), "
        "pc as (select a, b, count(*) as n from pr group by a, b), pt as (select a, sum(n) as t from pc group by a), "
        "tg as (select * from (values ('a', 0), ('n', 1), ('v', 2)) x(tag, k)), "
        f"st as (select list({_LN.format(c='coalesce(pc.n, 0)', t='pt.t', k=_K)} order by tg.k) as w from tg cross join pt "
        "left join pc on pc.a is null and pc.b = tg.tag where pt.a is null), "
        f"fo as (select list({_LN.format(c='coalesce(pc.n, 0)', t='pt.t', k=_K)} order by x.k, y.k) as w from tg x cross join tg y "
        "join pt on pt.a = x.tag left join pc on pc.a = x.tag and pc.b = y.tag), "
        "vo as (select count(distinct word) as v from tagged), ct as (select tag, count(*) as t from tagged group by tag), "
        "wc as (select word, tag, count(*) as n from tagged group by word, tag), "
        f"em as (select w.word, list({_LN.format(c='coalesce(wc.n, 0)', t='ct.t', k='v + 1')} order by tg.k) as e from (select distinct word from tagged) w "
        "cross join tg cross join vo join ct on ct.tag = tg.tag left join wc on wc.word = w.word and wc.tag = tg.tag group by w.word), "
        "sq as (select sentence, row_number() over (partition by sentence order by i) as k, word, e from tagged join em using (word)), "
        "vt as (select sentence, k, list_transform([1, 2, 3], lambda t: {'s': st.w[t] + e[t], 'p': substr('anv', t, 1)}) as ends from sq, st where k = 1 "
        "union all select q.sentence, q.k, list_transform([1, 2, 3], lambda t: {'s': q.m[t].s + q.e[t], 'p': q.m[t].p || substr('anv', t, 1)}) from "
        "(select sq.sentence, sq.k, sq.e, list_transform([1, 2, 3], lambda t: list_max(list_transform([1, 2, 3], "
        "lambda a: {'s': vt.ends[a].s + fo.w[(a - 1) * 3 + t], 'less': -a, 'p': vt.ends[a].p}))) as m "
        "from vt join sq on sq.sentence = vt.sentence and sq.k = vt.k + 1, fo) q), "
        "lst as (select sentence, max(k) as k from sq group by sentence) ")


@query("tag_sequences", with_views("tagged").replace("with ", "with recursive ", 1) + f", {_HMM}"
       "select vt.sentence, cast(vt.k as bigint) as n_words, list_max(list_transform([1, 2, 3], lambda a: {'s': ends[a].s, 'less': -a, 'p': ends[a].p})).p as tags "
       "from vt join lst on lst.sentence = vt.sentence and lst.k = vt.k")
def q_tag_sequences(spark, d):
    v = Views(spark, d)
    tagged = v.tagged()
    out = T.tag_words(T.fit_tagger(tagged), tagged.drop("tag"))
    return out.select("sentence", F.size("words").cast("long").alias("n_words"), F.array_join("tags", "").alias("tags"))


@query("score_sequence_model", None)
def q_score_sequence_model(spark, d):
    """All documents scored by a sequence model that learned from the labelled ones (a trained model: no SQL)."""
    v = Views(spark, d)
    labelled = v.posts_doc().join(v.t("labels").select(F.col("doc_id").alias("ord"), F.col("quality").alias("label")), "ord")
    scored = M.score_sequence_model(M.train_sequence_model(labelled, "ord"), v.posts_doc())
    return scored.select("ord", "sentiment_label", "sentiment_key", F.round("positive_probs", 4).alias("positive_probs"))
