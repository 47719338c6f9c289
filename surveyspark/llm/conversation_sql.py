"""The audit of damaged conversations as plain SQL: all prefixes row by row, the cheapest of each state kept."""

AUDIT = r"""
with recursive numbered as (
    select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
           coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as name
    from conversations
), marked as (
    -- crc32: each byte is mixed in, then eight shifts with the reversed polynomial
    select *, xor(4294967295, list_reduce(
        list_prepend(4294967295::bigint, list_transform(string_split(name, ''), lambda ch: ascii(ch)::bigint)),
        lambda c, b: list_reduce(list_prepend(xor(c, b), [0::bigint, 0, 0, 0, 0, 0, 0, 0]),
            lambda x, y: xor(x >> 1, 3988292384::bigint * (x & 1))))) % 20 as kind
    from numbered
), damaged as (
    select conv_id, turn, case when kind = 4 then 'user' else role end as role,
           case kind when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
           unnest(case when kind = 3 then [1, 2] else [1] end) as copy
    from marked where kind <> 0
), ordered as (
    select *, row_number() over (partition by conv_id order by turn nulls first, role, md5(text), copy) as pos from damaged
), facts as (
    select *, substr(role, 1, 1) as initial,
           case when not regexp_matches(text, '[^\x20\x09-\x0D]') then 'blank'
                when row_number() over (partition by conv_id, role, text order by pos) > 1 then 'duplicate'
                when not regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') then 'truncated'
                else '' end as fault,
           lag(substr(role, 1, 1)) over (partition by conv_id order by pos) as before
    from ordered
), inserts(q, k, z, lines) as (
    values ('', 0, '', ''), ('s', 0, 's', ''), ('u', 0, 'u', ''), ('a', 0, 'a', ''),
           ('', 1, 'u', chr(10) || 'user:'), ('s', 1, 'u', chr(10) || 'user:'), ('a', 1, 'u', chr(10) || 'user:'),
           ('u', 1, 'a', chr(10) || 'assistant:'),
           ('', 2, 'a', chr(10) || 'user:' || chr(10) || 'assistant:'), ('s', 2, 'a', chr(10) || 'user:' || chr(10) || 'assistant:')
), moves(q, initial, letter, price, z, name) as (
    values ('', 's', 'K', 0, 's', null), ('', 'u', 'K', 0, 'u', null), ('s', 'u', 'K', 0, 'u', null),
           ('a', 'u', 'K', 0, 'u', null), ('u', 'a', 'K', 0, 'a', null),
           ('', null, 'R', 3, 'u', 'user'), ('s', null, 'R', 3, 'u', 'user'), ('a', null, 'R', 3, 'u', 'user'),
           ('u', null, 'R', 3, 'a', 'assistant'),
           ('', null, 'D', 4, '', null), ('s', null, 'D', 4, 's', null), ('u', null, 'D', 4, 'u', null), ('a', null, 'D', 4, 'a', null)
), prefixes(conv_id, pos, q, cost, audit, lines) as (
    select distinct f.conv_id, 0::bigint, i.z, 3 * i.k, repeat('I', i.k), i.lines
    from facts f, inserts i where i.q = ''
    union all
    select conv_id, pos, q, cost, audit, lines from (
        select p.conv_id, f.pos, i.z as q, i.k,
               p.cost + m.price + 3 * i.k + case when m.letter <> 'D' and f.fault = 'truncated' then 3 else 0 end as cost,
               p.audit || m.letter || repeat('I', i.k) as audit,
               p.lines || case when m.letter = 'D' then '' else chr(10) || coalesce(m.name, f.role) || ':' || f.text end || i.lines as lines,
               row_number() over (partition by p.conv_id, i.z order by
                   p.cost + m.price + 3 * i.k + case when m.letter <> 'D' and f.fault = 'truncated' then 3 else 0 end,
                   p.audit || m.letter || repeat('I', i.k)) as nth
        from prefixes p
        join facts f on f.conv_id is not distinct from p.conv_id and f.pos = p.pos + 1
        join moves m on m.q = p.q and (m.initial is null or m.initial = f.initial)
             and (m.letter = 'D' or f.fault not in ('blank', 'duplicate'))
        join inserts i on i.q = m.z
    ) where nth = 1
), totals as (
    select conv_id, count(*) as n,
           coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps,
           count(*) filter (fault = 'blank') as blank, count(*) filter (fault = 'duplicate') as duplicate,
           count(*) filter (fault = 'truncated') as truncated,
           count(*) filter (before is not null and before || initial not in ('su', 'ua', 'au')) as illegal
    from facts group by conv_id
), chosen as (
    select p.conv_id, p.cost, p.audit, p.lines,
           row_number() over (partition by p.conv_id order by p.cost, p.audit) as nth
    from prefixes p join totals t on t.conv_id is not distinct from p.conv_id and t.n = p.pos
    where p.q in ('', 'a')
), ids as (
    select distinct conv_id from conversations
)
select i.conv_id, coalesce(t.gaps, 0)::bigint as gaps, coalesce(t.blank, 0) as blank, coalesce(t.duplicate, 0) as duplicate,
       coalesce(t.truncated, 0) as truncated, coalesce(t.illegal, 0) as illegal, coalesce(c.cost, 0)::bigint as cost,
       coalesce(c.audit, '') as audit, sha256(coalesce(substr(c.lines, 2), '')) as repaired_sha256
from ids i
left join totals t on t.conv_id is not distinct from i.conv_id
left join chosen c on c.conv_id is not distinct from i.conv_id and c.nth = 1
"""
