"""Corpus results that plain SQL can say over whole tables: benchmark windows and repeated passages."""

#: Windows of ten words of items (all words of shorter ones), looked up among the windows of documents.
DECONTAMINATION = r"""
with items as (
    select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                       '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
    from benchmark
), sized as (
    select item_id, w, least(10, len(w)) as n, unnest(range(1, len(w) - least(10, len(w)) + 2)) as i from items where len(w) > 0
), windows as (
    select distinct item_id, n, array_to_string(w[i:i + n - 1], ' ') as words from sized
), docs as (
    select row_number() over () as place, doc_id,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                              '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
    from documents
), starts as (
    select place, w, n, unnest(range(1, len(w) - n + 2)) as i from docs, (select distinct n from windows) where len(w) >= n
), found as (
    select s.place, s.i, s.n, v.item_id
    from (select place, i, n, array_to_string(w[i:i + n - 1], ' ') as words from starts) s join windows v using (n, words)
), hit as (
    select place, count(distinct k) as n_hit from (select place, unnest(range(i, i + n)) as k from found) group by place
), named as (
    select place, count(*) as n_items, string_agg(name, ',' order by name) as names
    from (select distinct place, item_id::varchar as name from found) group by place
)
select d.doc_id, len(d.w)::bigint as n_words, coalesce(h.n_hit, 0)::bigint as n_hit, coalesce(m.n_items, 0)::bigint as n_items,
       sha256(coalesce(m.names, '')) as items_sha256, coalesce(h.n_hit, 0) > 0 as contaminated
from docs d left join hit h using (place) left join named m using (place)
"""

#: Windows of 35 words that start at two places at least; the words they cover go.
REPEATED_PASSAGES = r"""
with docs as (
    select row_number() over () as place, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents
), windows as (
    select place, i, md5(array_to_string(w[i:i + 34], ' ')) as words
    from (select place, w, unnest(range(1, len(w) - 33)) as i from docs where len(w) >= 35)
), repeated as (
    select place, i from (select place, i, count(*) over (partition by words) as n from windows) where n > 1
), gone as (
    select distinct place, unnest(range(i, i + 35)) as k from repeated
), words as (
    select place, unnest(w) as word, unnest(range(1, len(w) + 1)) as k from docs
), kept as (
    select w.place, string_agg(w.word, ' ' order by w.k) as text from words w anti join gone g on g.place = w.place and g.k = w.k group by w.place
), removed as (
    select place, count(*) as n from gone group by place
)
select d.doc_id, len(d.w)::bigint as n_words, coalesce(r.n, 0)::bigint as n_removed, sha256(coalesce(k.text, '')) as kept_sha256
from docs d left join kept k using (place) left join removed r using (place)
"""
