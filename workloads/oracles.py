"""DuckDB SQL for each registered query that SQL can express, over the same whole tables."""

from __future__ import annotations

import re

from langweave.fixed_values import (
    ARABIZI_DIGITS,
    CS_RATIO_THRESHOLD,
    DETECTOR_NAME,
    FAILED_MESSAGE,
    FAILED_STATUS,
    GENERATOR_MODEL,
    GENERATOR_NAME,
    GOLD_SAMPLES,
    LABEL_NAMES,
    LABELS,
    LANGID_MIN_TOKENS,
    MAX_FEATURES,
    MAX_TOKENS,
    MIX_MIN_TOKENS,
    REJECT_MESSAGE,
    REJECT_STATUS,
    SILVER_CONFIDENCE,
    SYSTEM_PROMPTS,
    TEMPERATURE,
)
from workloads.derived import EMBEDDING_SIZE, MIXED, RATIO_WEIGHTS, TURNS

# The inside of each character class, stated here once more so that a wrong range in the library shows.
WS = (
    r"\x{9}-\x{D}\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
)
LATIN = "A-Za-z"
ARABIC = r"\x{600}-\x{6FF}"
HARAKAT = r"\x{64B}-\x{65F}\x{670}"
WORD = r"\p{L}\p{N}_"
MAPPED_DIGITS = "2356789"
# The derived texts hold one emoji, with a skin tone; test_text covers the other ranges.
EMOJI_IN_TEXTS = r"\x{1F44D}[\x{1F3FB}-\x{1F3FF}]?"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def gsub(text: str, pattern: str, to: str = "") -> str:
    return f"regexp_replace({text}, {q(pattern)}, {q(to)}, 'g')"


# ---- text functions as SQL expressions --------------------------------------------------------


def remove_urls(t):
    return gsub(t, rf"http[^{WS}]+|www\.[^{WS}]+")


def remove_mentions(t):
    return gsub(t, f"@[{WORD}]+")


def normalize_arabizi(t):
    for digit, letter in ARABIZI_DIGITS.items():
        t = gsub(gsub(t, f"([{LATIN}]){digit}", rf"\1{letter}"), f"{digit}([{LATIN}])", rf"{letter}\1")
    return t


def normalize_arabic(t):
    return gsub(f"translate({t}, 'إأآةىـ', 'اااهي')", f"[{HARAKAT}]")


def clean_whitespace(t):
    return f"trim({gsub(t, f'[{WS}]+', ' ')}, ' ')"


def strip(t):
    return gsub(t, f"^[{WS}]+|[{WS}]+$")


def normalize_text(t):
    lowered = f"lower({remove_mentions(remove_urls(f'coalesce({t}, {q('')})'))})"
    return clean_whitespace(normalize_arabic(normalize_arabizi(lowered)))


def tokens(t):
    return f"list_filter(string_split({clean_whitespace(t)}, ' '), lambda x: x <> '')"


def count_in(t, chars):
    return f"length({gsub(t, f'[^{chars}]')})"


def is_valid(t):
    letters, digits = count_in(t, LATIN + ARABIC), count_in(t, r"\p{Nd}")
    return f"coalesce({letters} >= 2 and {digits} <= {letters}, false)"


def is_arabizi(t):
    arab, latin = count_in(t, ARABIC), count_in(t, LATIN)
    share = f"({latin} / nullif({arab} + {latin}, 0))"
    some = (
        f"len(list_filter({tokens(f'lower({t})')}, lambda x: regexp_matches(x, '[{MAPPED_DIGITS}]') "
        f"and regexp_matches(x, '[{LATIN}]'))) > 0"
    )
    return f"coalesce({share} > 0.5 or ({share} > 0.3 and {some}), false)"


def ratio(t, chars):
    return (
        f"coalesce(len(list_filter({tokens(t)}, lambda x: regexp_matches(x, '[{chars}]'))) "
        f"/ nullif(len({tokens(t)}), 0), 0.0)"
    )


def script(label, t):
    return f"case when {label} = 'AR_DAR' then case when {is_arabizi(t)} then 'arabizi' else 'arabic' end end"


def prompt_key(label, script_value):
    return (
        f"case when {label} = 'AR_DAR' then case when {script_value} = 'arabizi' then 'AR_DAR_LAT' "
        f"else 'AR_DAR_AR' end else {label} end"
    )


# ---- shared tables ----------------------------------------------------------------------------

CLASS_IDS = "(values " + ", ".join(f"({i}, {q(x)})" for i, x in enumerate(LABELS)) + ") as class_ids(label_id, label)"
PROMPTS = "(values " + ", ".join(f"({q(k)}, {q(v)})" for k, v in SYSTEM_PROMPTS.items()) + ") as prompts(k, system_prompt)"
LABEL_LIST = "[" + ", ".join(q(x) for x in LABELS) + "]"


def with_(*ctes: str) -> str:
    return "with " + ",\n".join(ctes) + "\n"


MIXED_CTE = f"mixed as materialized ({MIXED})"
TURNS_CTE = f"turns as materialized ({TURNS})"

CLEANED_CTE = f"""cleaned as materialized (
  select doc_id, label_original, text_norm from (
    select doc_id, label_original, {normalize_text('text')} as text_norm
    from mixed where text is not null and {is_valid('text')})
  where length(text_norm) > 0)"""


def position(key, partition=""):
    by = f"partition by {partition} " if partition else ""
    return f"row_number() over ({by}order by md5(concat(cast({key} as varchar), ':42')), {key})"


def split_sql(rows: str, label="label_original", key="doc_id"):
    return f"""select * exclude (r, n), case when r * 10000 <= n * 7000 then 'train'
        when r * 10000 <= n * 8500 then 'valid' else 'test' end as split
      from (select *, {position(key, label)} as r, count(*) over (partition by {label}) as n from {rows})"""


SPLIT_CTE = f"corpus as materialized ({split_sql('cleaned')})"

UNIFIED_CTE = f"""unified as materialized (
  select * from (
    select concat('atlaset_', {position('doc_id')} - 1) as id, text as text_raw, 'AR_DAR' as label_original, 'Atlaset' as source
    from mixed where label_original = 'AR_DAR'
    union all
    select concat('fren_', {position('doc_id')} - 1), text, upper(lang), 'papluca' from mixed where lang in ('fr', 'en')
    union all
    select concat('nadi_', {position('doc_id')} - 1), text, label_original, 'NADI2022' from mixed where label_original = 'AR_MSA')
  where text_raw is not null)"""



def folded(first: int, last: int) -> str:
    """Four class scores from a stretch of the embedding, every fourth value added in order."""
    sums = (" + ".join(f"embedding[{i + 1}]::double" for i in range(first + k, last, 4)) for k in range(4))
    return "[" + ", ".join(sums) + "]"


HALF = EMBEDDING_SIZE // 2
PREDS_CTE = f"""halves as materialized (
  select vec_id, label, {folded(0, HALF)} as a, {folded(HALF, 2 * HALF)} as b from embeddings),
predicted as (
  select vec_id, {LABEL_LIST}[(label % 4) + 1] as y, {LABEL_LIST}[list_position(a, list_max(a))] as p,
    {LABEL_LIST}[list_position(b, list_max(b))] as p2 from halves),
preds as materialized (
  select * from predicted union all select -1 - vec_id, y, null, null from predicted where vec_id % 50 = 7)"""

CLASS_CTE = """classes as (
  select label, sum(tp) as tp, sum(t) as support, sum(pr) as predicted from (
    select y as label, 1 as t, 0 as pr, coalesce(y = p, false)::int as tp from preds
    union all select p, 0, 1, 0 from preds where p is not null) group by label),
scores as (
  select label, coalesce(tp / nullif(predicted, 0), 0.0) as precision, coalesce(tp / nullif(support, 0), 0.0) as recall,
    coalesce(2 * tp / nullif(predicted + support, 0), 0.0) as f1, support::bigint as support, tp
  from classes)"""

SOFTMAX_CTE = f"""z as (select vec_id, {folded(0, EMBEDDING_SIZE)} as z from embeddings),
long as (select vec_id, unnest([0, 1, 2, 3]) as class_id, unnest(z) as z, list_max(z) as top from z),
probs as (
  select vec_id, class_id, exp(z - top) / sum(exp(z - top)) over (partition by vec_id) as p from long)"""


def ratio_detection(rows: str, key: str, label: str = "d_label") -> str:
    """Detection by the fixed linear scorer for rows with text and text_norm."""
    margins = ", ".join(f"{a} * arab + {b} * latin + {c} * least(arab, latin) + {d}" for a, b, c, d in RATIO_WEIGHTS.values())
    return f"""ratios as materialized (
      select {key}, text, text_norm, {ratio('text_norm', ARABIC)} as arab, {ratio('text_norm', LATIN)} as latin from {rows}),
    margins as (select *, [{margins}]::double[] as z from ratios),
    exps as (select *, list_transform(z, lambda x: exp(x - list_max(z))) as e from margins),
    probs as (select *, list_transform(e, lambda x: x / list_sum(e)) as pr from exps),
    labelled as (select *, {LABEL_LIST}[list_position(pr, list_max(pr))] as {label} from probs),
    detected as materialized (
      select *, round(list_max(pr), 4) as confidence, {script(label, 'text')} as script from labelled)"""


# ---- term statistics --------------------------------------------------------------------------

WORD_TERMS = f"""words as materialized (
  select doc_id, regexp_extract_all(lower(text_norm), '[{WORD}]{{2,}}') as w from cleaned),
numbered as (select doc_id, unnest(w) as w1, generate_subscripts(w, 1) as i from words),
runs as (
  select doc_id, w1, lead(w1, 1) over o as w2, lead(w1, 2) over o as w3
  from numbered window o as (partition by doc_id order by i)),
terms as (
  select doc_id, w1 as term from runs
  union all select doc_id, w1 || ' ' || w2 from runs where w2 is not null
  union all select doc_id, w1 || ' ' || w2 || ' ' || w3 from runs where w3 is not null),
per_doc as materialized (select doc_id, term, count(*) as tf from terms group by doc_id, term)"""

CHAR_TERMS = f"""char_words as (
  select doc_id, ' ' || unnest(string_split({clean_whitespace('lower(text_norm)')}, ' ')) || ' ' as w from cleaned),
word_counts as (select doc_id, w, count(*) as c from char_words group by doc_id, w),
spans as (select doc_id, w, c, unnest([2, 3, 4]) as size from word_counts),
starts as (select doc_id, w, c, size, unnest(range(1, length(w) - size + 2)) as i from spans where length(w) >= size),
per_doc as materialized (
  select doc_id, substr(w, i, size) as term, sum(c)::bigint as tf from starts group by doc_id, term)"""

TERM_SUMMARY = """select doc_id, sum(tf)::int as n_terms, count(*)::int as n_distinct, min(term) as first_term,
  max(term) as last_term, sum(tf * length(term))::int as n_letters from per_doc group by doc_id"""


def tfidf_ctes(prefix=""):
    return f"""{prefix}vocab as materialized (
  select term, sum(tf)::bigint as total_tf, count(*) as df from {prefix}per_doc join corpus using (doc_id)
  where split = 'train' group by term order by total_tf desc, term limit {MAX_FEATURES}),
{prefix}weights as materialized (
  select doc_id, term, w / sqrt(sum(w * w) over (partition by doc_id)) as weight from (
    select doc_id, term, (1 + ln(tf)) * (ln((1 + n_docs) / (1 + df)) + 1) as w
    from {prefix}per_doc join {prefix}vocab using (term),
      (select count(*) as n_docs from corpus where split = 'train')))"""


SCALED = f"""ratio_rows as materialized (
  select doc_id, split, {ratio('text_norm', ARABIC)} as arab, {ratio('text_norm', LATIN)} as latin from corpus),
ratio_stats as (
  select avg(arab) as ma, coalesce(nullif(stddev_pop(arab), 0), 1) as sa, avg(latin) as ml,
    coalesce(nullif(stddev_pop(latin), 0), 1) as sl, avg(least(arab, latin)) as mc,
    coalesce(nullif(stddev_pop(least(arab, latin)), 0), 1) as sc
  from ratio_rows where split = 'train'),
scaled as (
  select doc_id, (arab - ma) / sa as arab_ratio, (latin - ml) / sl as latin_ratio,
    (least(arab, latin) - mc) / sc as cs_ratio from ratio_rows, ratio_stats)"""


def renamed(ctes: str, prefix: str) -> str:
    """The term CTEs under other names, so that both blocks fit in one statement."""
    names = "per_doc|terms|runs|numbered|words|char_words|word_counts|spans|starts"
    return re.sub(rf"\b({names})(?= as )|(?<=from )({names})\b", lambda m: prefix + m[0], ctes)


# ---- chat tables ------------------------------------------------------------------------------

REQUESTS_CTE = """requests as materialized (
  select turn_id, json_object('text', ' ' || text || chr(10))::varchar as body from turns
  union all
  select turn_id || '-faulty', case (conv_id * 7 + turn) % 11
    when 0 then '{"text":"  "}' when 1 then '{}' when 2 then '{"text":null}' when 3 then 'not json ' || text
    when 4 then '{"text":' || conv_id || '}' else '[' || conv_id || ']' end
  from turns where (conv_id * 7 + turn) % 11 <= 5)"""

ACCEPTED_CTE = f"""checked as materialized (
  select turn_id, nullif({strip('t')}, '') as text from (
    select turn_id, case when json_valid(body) and json_type(body, '$.text') = 'VARCHAR'
      then json_extract_string(body, '$.text') end as t from requests))"""

ASSEMBLED_CTE = f"""norm as (
  select turn_id, text, {normalize_text('text')} as text_norm, {strip('text')} as answer from turns),
{ratio_detection('norm', 'turn_id, answer')},
assembled as (
  select turn_id, answer, d_label as label, confidence, round(pr[1], 4) as score_dialect, round(pr[3], 4) as score_en,
    round(length(text) / 30000.0::double * 1000, 1) as detect_ms,
    round(length(answer) / 700.0::double * 1000, 1) as generate_ms, script,
    {prompt_key('d_label', 'script')} as prompt_key
  from detected)"""


# ---- fitted models ----------------------------------------------------------------------------

# No fit in SQL: these give what must hold for any weights.
UCORPUS_CTE = f"""ucleaned as materialized (
  select id, label_original, text_norm from (
    select id, label_original, {normalize_text('text_raw')} as text_norm from unified where {is_valid('text_raw')})
  where length(text_norm) > 0),
ucorpus as materialized ({split_sql('ucleaned', key='id')})"""

SUPPORTS = "select label_original as label, count(*) as support, true as passes from ucorpus where split = 'valid' group by 1"

# ---- silver labels ----------------------------------------------------------------------------


def tokens_with(t: str, chars: str) -> str:
    return f"len(list_filter({tokens(t)}, lambda x: regexp_matches(x, '[{chars}]')))"


SILVER_CTE = f"""scripted as materialized (
  select doc_id, label_original, text, text_norm, {is_arabizi('text')} as izi, len({tokens('text_norm')}) as n_tokens,
    {tokens_with('text_norm', ARABIC)} as n_arab, {tokens_with('text_norm', LATIN)} as n_latin from (
    select doc_id, label_original, text, {normalize_text('text')} as text_norm
    from mixed where text is not null and {is_valid('text')})
  where length(text_norm) > 0),
shares as (
  select *, coalesce(n_arab / nullif(n_tokens, 0), 0.0) as arab, coalesce(n_latin / nullif(n_tokens, 0), 0.0) as latin
  from scripted),
mixes as (
  select *, n_arab >= {MIX_MIN_TOKENS} and n_latin >= {MIX_MIN_TOKENS} and least(arab, latin) >= {CS_RATIO_THRESHOLD} as mix
  from shares),
silver as materialized (
  select doc_id, text, text_norm, case when mix then 'MIX'
      when label_original in ('AR_DAR', 'AR_MSA') and arab > latin then label_original
      when label_original in ('AR_DAR', 'AR_MSA') and izi then 'AR_DAR'
      when label_original not in ('AR_DAR', 'AR_MSA') and latin > arab and n_tokens >= {LANGID_MIN_TOKENS}
      then label_original end as silver_label,
    case when mix then 2 * least(arab, latin) else greatest(arab, latin) end as confidence
  from mixes)"""
SILVER_ROWS = """select doc_id, coalesce(silver_label, '(none)') as silver_label, round(confidence, 6) as confidence from silver"""


def per_group(rows: str, wanted: str) -> str:
    """The first rows of each label in the seeded order; ``wanted`` is over n (its rows), total and smallest."""
    return f"""select * from (
      select *, min(n) over () as smallest from (
        select *, {position('doc_id', 'label_original')} as r, count(*) over (partition by label_original) as n,
          count(*) over () as total from {rows})) where r <= {wanted}"""


def _on_mixed(expression: str) -> str:
    return with_(MIXED_CTE) + f"select doc_id, {expression} as out from mixed"


def _weight_expr(i: int) -> str:
    a, b, c, d = list(RATIO_WEIGHTS.values())[i]
    return f"{a} * arab + {b} * latin + {c} * least(arab, latin) + {d}"


ORACLES: dict[str, str] = {
    "train_linear_svm": with_(MIXED_CTE, UNIFIED_CTE, UCORPUS_CTE) + SUPPORTS,
    "train_softmax": with_(MIXED_CTE, UNIFIED_CTE, UCORPUS_CTE) + SUPPORTS,
    "select_best_model": "select model, 1::bigint as n_best, true as best_is_max from "
    "(select concat(reg, ' step=', step) as model from (values ('reg=0.01'), ('reg=0.001'), ('reg=0.0001')) as regs(reg), "
    "(values ('1'), ('2'), ('3')) as steps(step))",
    "save_model": with_(
        MIXED_CTE,
        UNIFIED_CTE,
        UCORPUS_CTE,
        "cleaned as materialized (select id as doc_id, text_norm from ucorpus where split = 'train')",
        WORD_TERMS,
    )
    + f"""select 'svm' as kind, (row_number() over (order by label) - 1)::int as label_id, label,
      (select least({MAX_FEATURES}, count(distinct term)) from per_doc) as n_word_terms
      from (select distinct label_original as label from ucorpus where split = 'train')""",
    "load_model": with_(MIXED_CTE, UNIFIED_CTE, UCORPUS_CTE) + "select id, true as same from ucorpus where split = 'valid'",
    "detect": with_(TURNS_CTE)
    + f"""select turn_id, {is_arabizi('text')}::int as arabizi, 1.0::double as score_sum, true as label_is_top,
      true as script_follows from turns""",
    "compare_models": with_(MIXED_CTE)
    + """select model, doc_id, label_original as expected, true as consistent
      from mixed, (values ('svm on words'), ('softmax on characters')) as models(model) where text is not null""",
    "external_model": with_(
        MIXED_CTE,
        """lettered as (select doc_id, text, length(regexp_replace(text, '[^aeiou]', '', 'g')) as v,
          length(regexp_replace(text, '[^b-df-hj-np-tv-z]', '', 'g')) as c, length(regexp_replace(text, '[^0-9]', '', 'g')) as d
          from mixed)""",
    )
    + """select doc_id, 3 * v + c + 5 * d as n_points, case when v >= greatest(c, d) then 'vowels' when d >= c then 'digits'
        else 'consonants' end as top, round(v / nullif(length(text), 0), 6) as vowel_share from lettered where text is not null
      union all select doc_id, null, null, null from mixed where text is null""",
    "dialect_msa_classifier": with_(
        MIXED_CTE, CLEANED_CTE, SPLIT_CTE, f"arabic as (select *, {ratio('text_norm', ARABIC)} as arab from corpus)"
    )
    + """select label_original as label, count(*) as support, true as passes from arabic
      where split = 'valid' and arab > 0 and label_original in ('AR_DAR', 'AR_MSA') group by 1""",
    "silver_labels": with_(MIXED_CTE, SILVER_CTE) + SILVER_ROWS,
    "silver_filter": with_(MIXED_CTE, SILVER_CTE)
    + f"{SILVER_ROWS} where silver_label is not null and confidence >= {SILVER_CONFIDENCE}",
    "gold_sample": with_(MIXED_CTE)
    + f"select doc_id, label_original, md5(text) as h from ({per_group('mixed', f'ceil(n * {GOLD_SAMPLES} / total)')})",
    "ingest_gold": with_(MIXED_CTE)
    + """select doc_id, case when doc_id % 4 = 3 then 'MIX' else label_original end as gold_label, md5(text) as h
      from mixed where doc_id % 4 <> 2""",
    "rebalance_classes": with_(MIXED_CTE)
    + f"select doc_id, label_original, md5(text) as h from ({per_group('mixed', 'smallest')})",
    "postprocess_predictions": with_(
        MIXED_CTE, SILVER_CTE, ratio_detection("(select doc_id, text, text_norm, silver_label from silver)", "doc_id, silver_label")
    )
    + f"""select doc_id, d_label as pred, confidence,
      case when confidence >= {SILVER_CONFIDENCE} then d_label else coalesce(silver_label, d_label) end as final_label
      from detected""",
    "scan_parquet_corpus": "select doc_id, lang, length(text)::int as n_text from documents",
    "scan_csv_optional": with_(MIXED_CTE)
    + "select doc_id, label_original as label, length(text)::int as n_text, md5(text) as h from mixed",
    "scan_multi_split": with_(MIXED_CTE)
    + "select doc_id, upper(lang) as labels, md5(text) as h from mixed where lang in ('fr', 'en')",
    "sink_parquet_if_absent": "select doc_id, lang, md5(text) as h from documents",
    "sink_splits": with_(MIXED_CTE, CLEANED_CTE, SPLIT_CTE) + "select doc_id, label_original, split from corpus",
    "emit_responses": with_(TURNS_CTE, ASSEMBLED_CTE)
    + f"""select turn_id, md5(answer) as answer_hash, label, script, prompt_key, detect_ms, score_en,
      {q(GENERATOR_NAME)} as generator, (script is null)::int as script_is_null from assembled""",
    "project_source": with_(MIXED_CTE)
    + "select doc_id, md5(text) as h, 'AR_DAR' as label_original, 'Atlaset' as source from mixed",
    "filter_langs": "select doc_id, upper(lang) as labels from documents where lang in ('fr', 'en')",
    "assign_ids": with_(MIXED_CTE)
    + f"select concat('fren_', {position('doc_id')} - 1) as id, doc_id, md5(text) as h from mixed",
    "drop_null_text": with_(MIXED_CTE) + "select doc_id, label_original from mixed where text is not null",
    "filter_valid_text": with_(MIXED_CTE) + f"select doc_id from mixed where {is_valid('text')}",
    "filter_nonempty_norm": with_(MIXED_CTE)
    + f"""select * from (select doc_id, length({normalize_text('text')})::int as n_norm from mixed) where n_norm > 0""",
    "error_rows": with_(PREDS_CTE) + "select vec_id, y, p, '✗' as mark from preds where y is distinct from p",
    "label_encode": with_(MIXED_CTE)
    + """select doc_id, label_original, (d.r - 1)::int as label_id from mixed join
      (select label_original as l, row_number() over (order by label_original) as r
       from (select distinct label_original from mixed)) d on d.l = label_original""",
    "label_decode": f"""select vec_id, embeddings.label as class_id, class_ids.label as label
      from embeddings left join {CLASS_IDS} on class_ids.label_id = embeddings.label""",
    "prompt_lookup": with_(TURNS_CTE, f"keyed as (select turn_id, label, {script('label', 'text')} as s from turns)")
    + f"""select turn_id, pk as prompt_key, coalesce(system_prompt, '(unknown key)') as system_prompt
      from (select turn_id, {prompt_key('label', 's')} as pk from keyed) left join {PROMPTS} on pk = k""",
    "label_display": with_(TURNS_CTE)
    + f"""select turn_id, label, coalesce(n, label) as display_name, (label in ('AR_DAR', 'AR_MSA'))::int as rtl
      from turns left join (values {', '.join(f'({q(k)}, {q(v)})' for k, v in LABEL_NAMES.items())}) as names(k, n)
      on k = label""",
    "row_funnel": with_(MIXED_CTE, CLEANED_CTE)
    + f"""select count(text) as n_raw, count(*) filter (where {is_valid('text')}) as n_valid,
      (select count(*) from cleaned) as n_normalised from mixed""",
    "source_counts": with_(MIXED_CTE, UNIFIED_CTE)
    + f"""select source, count(*) as n_rows from unified
      where {is_valid('text_raw')} and length({normalize_text('text_raw')}) > 0 group by source""",
    "split_report": with_(MIXED_CTE, CLEANED_CTE, SPLIT_CTE)
    + "select split, count(*) as n_rows, round(count(*) / sum(count(*)) over (), 6) as share from corpus group by split",
    "confusion_matrix": with_(PREDS_CTE)
    + "select y, " + ", ".join(f"count(*) filter (where p = {q(x)}) as {q(x).replace(chr(39), chr(34))}" for x in LABELS)
    + " from preds group by y",
    "accuracy": with_(PREDS_CTE) + "select round(avg(coalesce(y = p, false)::int), 6) as accuracy from preds",
    "macro_f1": with_(PREDS_CTE, CLASS_CTE) + "select round(avg(f1), 6) as macro_f1 from scores",
    "classification_report": with_(PREDS_CTE, CLASS_CTE)
    + """select label, round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1, support from scores
      union all select 'accuracy', round(sum(tp) / sum(support), 6), round(sum(tp) / sum(support), 6),
        round(sum(tp) / sum(support), 6), sum(support)::bigint from scores
      union all select 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), sum(support)::bigint
        from scores
      union all select 'weighted avg', round(sum(precision * support) / sum(support), 6),
        round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6), sum(support)::bigint
        from scores""",
    "robustness_score": with_(PREDS_CTE)
    + """select 'first' as model, count(*) filter (where p = y) as n_correct, count(*) as n_total from preds
      union all select 'second', count(*) filter (where p2 = y), count(*) from preds""",
    "distinct_labels": with_(MIXED_CTE) + "select distinct label_original from mixed",
    "class_weights": with_(MIXED_CTE)
    + """select label_original, count(*) as n_rows,
      round(sum(count(*)) over () / (count(*) over () * count(*)), 6) as weight from mixed group by label_original""",
    "stratified_split": with_(MIXED_CTE)
    + f"select doc_id, label_original, split, md5(text) as h from ({split_sql('mixed')})",
    "sample_exact": with_(MIXED_CTE)
    + f"""select doc_id, md5(text) as h from mixed qualify {position('doc_id')} <= 500""",
    "vocab_topk": with_(MIXED_CTE, CLEANED_CTE, WORD_TERMS)
    + f"""select term, sum(tf)::bigint as total_tf, count(*) as df from per_doc group by term
      order by total_tf desc, term limit {MAX_FEATURES}""",
    "argmax_label": with_(f"z as (select vec_id, {folded(0, EMBEDDING_SIZE)} as z from embeddings)")
    + f"""select vec_id, {LABEL_LIST}[list_position(z, list_max(z))] as label, round(list_max(z), 6) as score from z""",
    "ranked_scores": with_(SOFTMAX_CTE)
    + f"""select vec_id, row_number() over (partition by vec_id order by s desc, class_id)::int as rank,
      {LABEL_LIST}[class_id + 1] as label, s as score from (select vec_id, class_id, round(p, 2) as s from probs)""",
    "union_sources": with_(MIXED_CTE, UNIFIED_CTE)
    + "select id, label_original, source, md5(text_raw) as h from unified",
    "remove_urls": _on_mixed(remove_urls("text")),
    "remove_mentions": _on_mixed(remove_mentions("text")),
    "remove_hashtags": _on_mixed(gsub("text", f"#[{WORD}]+")),
    "remove_emojis": _on_mixed(gsub("text", EMOJI_IN_TEXTS)),
    "lowercase_text": _on_mixed("lower(text)"),
    "normalize_arabizi": _on_mixed(normalize_arabizi("text")),
    "normalize_arabic": _on_mixed(normalize_arabic("text")),
    "clean_whitespace": _on_mixed(clean_whitespace("text")),
    "normalize_text": _on_mixed(normalize_text("text")),
    "is_valid_text": _on_mixed(f"{is_valid('text')}::int"),
    "is_arabizi": _on_mixed(f"{is_arabizi('text')}::int"),
    "tokenize_ws": with_(MIXED_CTE, f"cut as (select doc_id, {tokens('text')} as tokens from mixed)")
    + "select doc_id, len(tokens)::int as n_tokens, md5(array_to_string(tokens, '|')) as h from cut",
    "script_ratios": with_(
        MIXED_CTE,
        f"norm as materialized (select doc_id, {normalize_text('text')} as t from mixed)",
        f"r as (select doc_id, {ratio('t', ARABIC)} as arab, {ratio('t', LATIN)} as latin from norm)",
    )
    + """select doc_id, round(arab, 6) as arab_ratio, round(latin, 6) as latin_ratio,
      round(least(arab, latin), 6) as cs_ratio from r""",
    "script_of_dialect": with_(MIXED_CTE)
    + f"select doc_id, coalesce({script('label_original', 'text')}, '(null)') as script from mixed",
    "prompt_key": with_(MIXED_CTE, f"s as (select doc_id, label_original, {script('label_original', 'text')} as s from mixed)")
    + f"select doc_id, {prompt_key('label_original', 's')} as prompt_key from s",
    "strip_answer": with_(TURNS_CTE) + f"select turn_id, {strip('text')} as answer from turns",
    "word_ngrams": with_(MIXED_CTE, CLEANED_CTE, WORD_TERMS) + TERM_SUMMARY,
    "char_wb_ngrams": with_(MIXED_CTE, CLEANED_CTE, CHAR_TERMS) + TERM_SUMMARY,
    "tfidf_word": with_(MIXED_CTE, CLEANED_CTE, SPLIT_CTE, WORD_TERMS, tfidf_ctes())
    + "select doc_id, term, round(weight, 6) as weight from weights",
    "tfidf_char": with_(MIXED_CTE, CLEANED_CTE, SPLIT_CTE, CHAR_TERMS, tfidf_ctes())
    + "select doc_id, term, round(weight, 6) as weight from weights",
    "scale_features": with_(MIXED_CTE, CLEANED_CTE, SPLIT_CTE, SCALED)
    + """select doc_id, round(arab_ratio, 6) as arab_ratio, round(latin_ratio, 6) as latin_ratio,
      round(cs_ratio, 6) as cs_ratio from scaled""",
    "assemble_features": with_(
        MIXED_CTE,
        CLEANED_CTE,
        SPLIT_CTE,
        renamed(WORD_TERMS, "w_"),
        tfidf_ctes("w_"),
        renamed(CHAR_TERMS, "c_"),
        tfidf_ctes("c_"),
        SCALED,
        "sizes as (select (select count(*) from w_vocab) + (select count(*) from c_vocab) + 3 as n_slots)",
        """entries as (select doc_id, weight from w_weights union all select doc_id, weight from c_weights
          union all select doc_id, unnest([arab_ratio, latin_ratio, cs_ratio]) from scaled)""",
    )
    + """select doc_id, n_slots::int as n_slots, count(*)::int as n_entries, (n_slots - 1)::int as last_slot,
      round(sum(weight), 4) as total from entries, sizes group by doc_id, n_slots""",
    "score_linear": with_(
        MIXED_CTE,
        CLEANED_CTE,
        f"r as materialized (select doc_id, {ratio('text_norm', ARABIC)} as arab, {ratio('text_norm', LATIN)} as latin from cleaned)",
        f"z as (select doc_id, [{', '.join(_weight_expr(i) for i in range(4))}]::double[] as z from r)",
    )
    + f"select doc_id, {LABEL_LIST}[list_position(z, list_max(z))] as label, round(list_max(z), 6) as score from z",
    "softmax_scores": with_(SOFTMAX_CTE) + "select vec_id, class_id, round(p, 6) as p from probs",
    "score_map": with_(SOFTMAX_CTE)
    + f"select vec_id, {LABEL_LIST}[class_id + 1] as label, round(p, 4) as score from probs",
    "detection_record": with_(
        MIXED_CTE,
        f"norm as (select doc_id, text, {normalize_text('text')} as text_norm from mixed)",
        ratio_detection("norm", "doc_id"),
    )
    + f"""select doc_id, d_label as label, confidence, coalesce(script, '(null)') as script,
      round(pr[4], 4) as score_fr, {q(DETECTOR_NAME)} as detector_name from detected""",
    "stream_detect": with_(
        TURNS_CTE,
        REQUESTS_CTE,
        ACCEPTED_CTE,
        f"norm as (select turn_id, text, {normalize_text('text')} as text_norm from checked where text is not null)",
        ratio_detection("norm", "turn_id"),
    )
    + f"""select turn_id, 'accepted' as outcome, md5(text_norm) as h, d_label as label, confidence,
      coalesce(script, '(null)') as script, {prompt_key('d_label', 'script')} as prompt_key from detected
      union all select turn_id, 'rejected', '', '', 0.0, '', '' from checked where text is null""",
    "validate_requests": with_(TURNS_CTE, REQUESTS_CTE, ACCEPTED_CTE)
    + f"""select turn_id, case when text is null then {REJECT_STATUS} else 200 end as status,
      coalesce(text, {q(REJECT_MESSAGE)}) as text from checked""",
    "build_generation_requests": with_(
        TURNS_CTE,
        f"tagged as (select turn_id, text, label, {script('label', 'text')} as s from turns)",
        f"keyed as (select turn_id, text, {prompt_key('label', 's')} as pk from tagged)",
    )
    + f"""select turn_id, pk as prompt_key, case when k is null then '(none)' else 'system' end as first_role,
      case when k is null then '(none)' else md5(system_prompt) end as system_hash,
      case when k is null then '(none)' else {strip('text')} end as user_text,
      case when k is null then '(none)' else {q(GENERATOR_MODEL)} end as model,
      case when k is null then 0.0 else {TEMPERATURE} end::double as temperature,
      case when k is null then 0 else {MAX_TOKENS} end as max_tokens
      from keyed left join {PROMPTS} on pk = k""",
    "parse_generation_results": with_(TURNS_CTE)
    + f"select turn_id, {strip('text')} as answer, {q(GENERATOR_NAME)} as generator_name from turns",
    "assemble_turns": with_(TURNS_CTE, ASSEMBLED_CTE)
    + f"""select turn_id, md5(answer) as answer_hash, label, confidence, score_dialect, detect_ms, generate_ms,
      {q(DETECTOR_NAME)} as detector, coalesce(script, '(null)') as script, prompt_key, 200 as status from assembled
      union all select turn_id || '-lost', {q(FAILED_MESSAGE)}, '', 0.0, 0.0, 0.0, 0.0, '', '', '', {FAILED_STATUS}
      from turns where conv_id % 7 = 3""",
    "turn_timings": """select event_id, round(coalesce(round(value / 1000.0::double * 1000, 1), 0)
      + coalesce(case when event_type <> 'error' then round(value / 7.0::double * 1000, 1) end, 0), 1) as total_ms
      from events""",
}
