"""DuckDB SQL for those operator queries that SQL can express."""


def _plus(label: str, cost: str, letter: str) -> str:
    """A label (nine digits of cost, then edits) after one more edit."""
    return f"lpad((substr({label}, 1, 9)::int + {cost})::varchar, 9, '0') || substr({label}, 10) || '{letter}'"


def _least(*labels: str) -> str:
    return "least(" + ", ".join(labels) + ")"


_NEVER = "'500000000'"


def _when(condition: str, label: str) -> str:
    return f"case when {condition} then {label} else {_NEVER} end"


def _turn_repair() -> str:
    """Damage and faults by windows; one label for each state of the roles, carried from row to row; then its edits."""
    spaces = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    keep, rerole = (lambda label: _plus(label, "extra", "K")), (lambda label: _plus(label, "extra + 1", "R"))
    to_user = ("w0", "w1", "w3")
    stepped = {
        "v0": _plus("w0", "2", "D"),
        "v1": _least(_plus("w1", "2", "D"), _when("not gone and initial = 's'", keep("w0"))),
        "v2": _least(
            _plus("w2", "2", "D"),
            *[_when("not gone and initial = 'u'", keep(w)) for w in to_user],
            *[_when("not gone", rerole(w)) for w in to_user],
        ),
        "v3": _least(
            _plus("w3", "2", "D"), _when("not gone and initial = 'a'", keep("w2")), _when("not gone", rerole("w2"))
        ),
    }
    steps = ", ".join(f"{label} as {name}" for name, label in stepped.items())
    w2 = _least("v2", *[_plus(v, "5", "I") for v in ("v0", "v1", "v3")])
    return rf"""
        with recursive keyed as (
            select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
                coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as k
            from conversations
        ), hashed as (
            select *, xor(4294967295, list_reduce(
                list_prepend(4294967295::bigint, flatten(list_transform(string_split(k, ''),
                    lambda c: list_transform(range(8), lambda b: ((ord(c)::bigint >> b) & 1)::bigint)))),
                lambda a, b: xor(a >> 1, case when xor(a, b) & 1 = 1 then 3988292384::bigint else 0::bigint end))) % 20 as f
            from keyed
        ), damaged as (
            select conv_id, turn, case when f = 4 then 'user' else role end as role,
                case when f = 1 then '' when f = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
                unnest(case when f = 3 then [0, 1] else [0] end) as copy
            from hashed where f <> 0
        ), placed as (
            select *, rtrim(text, {spaces}) as bare, left(role, 1) as initial,
                row_number() over (partition by conv_id order by turn nulls first, left(role, 64), left(text, 64),
                    sha256(role || chr(0) || text), copy) as i
            from damaged
        ), faulty as (
            select *, case when bare = '' then 'blank'
                when row_number() over (partition by conv_id, role, text order by i) > 1 then 'duplicate'
                when right(bare, 1) not in ('.', '!', '?') then 'truncated' else '' end as fault,
                lag(initial) over (partition by conv_id order by i) || initial as pair
            from placed
        ), steps as (
            select *, fault in ('blank', 'duplicate') as gone, case when fault = 'truncated' then 5 else 0 end as extra
            from faulty
        ), ids as (select distinct conv_id from conversations
        ), reached as (
            select conv_id, 0::bigint as i, lpad('0', 9, '0') as v0, {_NEVER} as v1, {_NEVER} as v2, {_NEVER} as v3 from ids
            union all
            select conv_id, i, {steps}
            from (
                select s.conv_id, s.i, s.initial, s.gone, s.extra, v0 as w0, v1 as w1, w2,
                    {_least("v3", _plus("w2", "5", "I"))} as w3
                from (select *, {w2} as w2 from reached) r
                join steps s on s.conv_id is not distinct from r.conv_id and s.i = r.i + 1
            )
        ), solved as (
            select conv_id, {_least("v0", _least("v3", _plus("w2", "5", "I")))} as label
            from (select *, {w2} as w2 from reached)
            qualify row_number() over (partition by conv_id order by i desc) = 1
        ), walked as (
            select conv_id, substr(label, 10) as audit, 0 as p, 0::bigint as i, 0 as state, '' as done, false as begun
            from solved
            union all
            select conv_id, audit, p + 1, i + (letter <> 'I')::int, state_after,
                case when letter = 'D' then done else done || case when begun then chr(10) else '' end
                    || case when letter = 'K' then role when state_after = 2 then 'user' else 'assistant' end
                    || ':' || case when letter = 'I' then '' else text end end,
                begun or letter <> 'D'
            from (
                select w.*, substr(audit, p + 1, 1) as letter, s.role, s.text,
                    case when substr(audit, p + 1, 1) = 'D' then state
                        when substr(audit, p + 1, 1) = 'K' and s.initial = 's' then 1
                        when state = 2 then 3 else 2 end as state_after
                from walked w left join steps s on s.conv_id is not distinct from w.conv_id and s.i = w.i + 1
                where p < length(audit)
            )
        ), repaired as (
            select conv_id, audit, sha256(done) as repaired_sha256 from walked where p = length(audit)
        ), counts as (
            select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps,
                count_if(fault = 'blank') as blank, count_if(fault = 'duplicate') as duplicate,
                count_if(fault = 'truncated') as truncated,
                count_if(i > 1 and pair not in ('su', 'ua', 'au')) as illegal
            from faulty group by conv_id
        )
        select s.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank,
            coalesce(duplicate, 0)::bigint as duplicate, coalesce(truncated, 0)::bigint as truncated,
            coalesce(illegal, 0)::bigint as illegal, substr(label, 1, 9)::bigint as cost, audit, repaired_sha256
        from solved s join repaired r on s.conv_id is not distinct from r.conv_id
        left join counts c on s.conv_id is not distinct from c.conv_id
    """


def _escaped(text: str) -> str:
    """The text with a backslash doubled and one put after the first character of every control string."""
    doubled = rf"replace({text}, '\', '\\')"
    return rf"regexp_replace({doubled}, '([<\[])(\||/?s>|/?INST\])', '\1\\\2', 'g')"


def _chat_format() -> str:
    """Digests of the turns in order; a formatted turn is its escaped role and text and 23 characters of marks."""
    order = "order by turn nulls first, role, text"
    tricky = "'</s>[INST] ok [/INST]'"
    return f"""
        with turns as (
            select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
            union all select -1, 0, 'user', {tricky}
            union all select -1, 1, 'assistant', {tricky}
        )
        select conv_id, count(*) as n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' {order})) as turns_sha256,
            coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
            sha256(coalesce(string_agg(text, '' {order}) filter (role = 'assistant'), '')) as loss_sha256,
            sum(length({_escaped("role")}) + length({_escaped("text")}) + 23)::bigint as formatted_chars
        from turns group by conv_id
    """


ORACLES = {
    "op3_exact_dedup": r"""
        with digested as (
            select doc_id, sha256(regexp_replace(coalesce(text, ''), '[ \t\n\x0B\x0C\r]+', ' ', 'g')) as text_sha256
            from documents
        )
        select doc_id, text_sha256,
            min(doc_id) over (partition by text_sha256) as keep_id,
            count(*) over (partition by text_sha256) as group_size,
            doc_id = min(doc_id) over (partition by text_sha256) as kept
        from digested
    """,
    "op7_chat_format": _chat_format(),
    "op11_turn_repair": _turn_repair(),
    "op12_suffix_dedup": r"""
        with bytes as (
            select row_number() over () as r, doc_id, hex(encode(coalesce(text, ''))) as h from documents
        ), starts as (
            select r, doc_id, unnest(range(length(h) // 2 - 49)) as p from bytes where length(h) >= 100
        ), strings as (
            select s.r, s.doc_id, p, md5(substr(h, 2 * p + 1, 100)) as w from starts s join bytes b on s.r = b.r
        ), repeats as (
            select r, p from (select *, min(doc_id) over (partition by w) as holder from strings) where holder < doc_id
        ), covered as (
            select distinct r, unnest(range(p, p + 50)) as p from repeats
        ), every as (
            select r, unnest(range(length(h) // 2)) as p from bytes where r in (select r from repeats)
        ), marked as (
            select e.r, e.p, c.p is not null as gone,
                coalesce(lag(c.p is not null) over (partition by e.r order by e.p), false) as gone_before
            from every e left join covered c on e.r = c.r and e.p = c.p
        ), kept as (
            select m.r, count_if(gone) as n_removed, count_if(gone and not gone_before) as n_spans,
                coalesce(string_agg(substr(h, 2 * p + 1, 2), '' order by p) filter (not gone), '') as rest
            from marked m join bytes b on m.r = b.r group by m.r
        )
        select doc_id, length(h) // 2 as n_bytes, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans,
            sha256(unhex(coalesce(rest, h))) as kept_sha256
        from bytes b left join kept k on b.r = k.r
    """,
}
