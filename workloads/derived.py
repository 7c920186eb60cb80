"""Inputs derived from the given tables by SQL that reads the same in Spark and in DuckDB.

The given texts hold no Arabic, URLs or hashtags, so whole texts are rewritten: German ones into
Arabic letters (standing for MSA), Spanish ones into arabizi and mixed script (dialect), half of the
French and English ones get a URL, a mention, a hashtag and an emoji, some texts become digits only or a
bare URL, and rows with a null text are added.
"""

from __future__ import annotations

_LATIN = "abcdefghijklmnopqrstuvwxyz" + "äöüßáéíóúñ"
_ARABIC = "ابجدةفغحىعكلمنوپقرسطآڤشخيز" + "إّٰـَِأُْئ"


def in_arabic(text: str) -> str:
    return f"translate(lower({text}), '{_LATIN}', '{_ARABIC}')"


def in_arabizi(text: str) -> str:
    return f"translate(lower({text}), 'hqgkt', '79865')"


def as_text(number: str) -> str:
    return f"cast({number} as varchar(20))"


MIXED = f"""
select doc_id, lang, source,
  case lang when 'de' then 'AR_MSA' when 'es' then 'AR_DAR' else upper(lang) end as label_original,
  case
    when doc_id % 10 = 4 then translate(lower(text), 'abcdefghijklmnopqrstuvwxyz', '01234567890123456789012345')
    when doc_id % 20 = 6 then concat('http://ex.ma/', replace(replace(text, ' ', ''), chr(10), ''))
    when lang = 'de' then {in_arabic('text')}
    when lang = 'es' and doc_id % 2 = 0 then {in_arabizi('text')}
    when lang = 'es' then concat({in_arabizi('text')}, ' ', {in_arabic('text')})
    when doc_id % 2 = 0 then text
    else concat('http://ex.ma/p?q=', {as_text('doc_id')}, '\u00a0', text, '  @user_', {as_text('doc_id')},
                ' #tag\u2003\U0001f44d\U0001f3fd ok ')
  end as text
from documents
union all
select -1 - doc_id, lang, source, case lang when 'de' then 'AR_MSA' when 'es' then 'AR_DAR' else upper(lang) end, null
from documents where doc_id % 25 = 8
"""

TURNS = f"""
select concat({as_text('conv_id')}, '-', {as_text('turn')}) as turn_id, conv_id, turn, role,
  case (conv_id + turn) % 3 when 0 then text when 1 then {in_arabizi('text')} else {in_arabic('text')} end as text,
  case conv_id % 5 when 0 then 'AR_DAR' when 1 then 'AR_MSA' when 2 then 'EN' when 3 then 'FR' else 'MIX' end as label
from conversations
"""

EMBEDDING_SIZE = 64
# Fixed weights of a linear scorer over the three script ratios: label -> (arab, latin, cs, intercept).
RATIO_WEIGHTS = {
    "AR_DAR": (0.5, 1.0, 4.0, -0.25),
    "AR_MSA": (3.0, -1.0, -2.0, 0.0),
    "EN": (-1.0, 2.0, -1.0, 0.25),
    "FR": (-1.0, 1.5, 0.5, 0.5),
}
