"""The queries of this subpackage, by name, and their check SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_vector_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    """Links of all embeddings with cosine >= 0.9, whatever their labels."""
    from emberfield.llm.vector_graph import near_duplicates

    return near_duplicates(_table(spark, folder, "embeddings"))


def op6_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    """Components of all documents under 5-word shingle Jaccard >= 0.75."""
    from emberfield.llm.jaccard_tiles import shingle_components

    return shingle_components(_table(spark, folder, "documents"))


def op4_best_two_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Pieces of all documents, packed into sequences of at most 1024 tokens."""
    import public_tokenizers

    from emberfield.llm.best_two_fit import packed_documents

    return packed_documents(_table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end=2)


def op10_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every document; a quarter of them is never learned from."""
    from emberfield.llm.language_backoff import fit, held_out, predict

    docs = _table(spark, folder, "documents")
    model = fit(docs.where(~held_out()).select("doc_id", "text", "lang"))
    return predict(docs.select("doc_id", held_out().alias("held_out"), "text"), model).drop("text")


def op5_line_crf_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Base counts of every document and the verdict of the line labels."""
    from emberfield.llm.line_crf import fit, judge

    docs = _table(spark, folder, "documents").select("doc_id", "text")
    return judge(docs, fit(docs, _table(spark, folder, "labels"))).drop("text")


def op3_rank_code_files(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of all documents, written to code files and read back."""
    import public_tokenizers

    from emberfield.llm import rank_codes
    from emberfield.session import scratch_path

    target = scratch_path(spark, "rank-codes")
    rank_codes.write(_table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"), 1, target)
    return rank_codes.read(spark, target)


def op9_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Byte-level BPE ids of all documents, and their bytes decoded again, as digests."""
    import public_tokenizers

    from emberfield.llm.bpe_ranks import encode_decode

    docs = _table(spark, folder, "documents").select("doc_id", "text")
    return encode_decode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op2_chat_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Digests of all conversations, read back from their formatted windows."""
    from emberfield.llm.chat_windows import digests, windows

    said = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame(
        [(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string"
    )
    turns = _table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").union(extra)
    return digests(windows(turns))


def op7_merkle_fixity(spark: SparkSession, folder: str) -> DataFrame:
    """WARC records of all pages, and the faults that the audit finds in a damaged replica.

    The replica is a stored copy in which records of some ids are altered or lost.
    """
    from emberfield.llm import merkle_warc
    from emberfield.session import materialize

    first = materialize(merkle_warc.archive(_table(spark, folder, "pages")), "warc")
    place = F.pmod("page_id", F.lit(101))
    damaged = first.withColumn(
        "record",
        F.when(place == 7, F.overlay("record", F.lit(b"?"), F.lit(3))).when(place == 8, F.lit(None)).otherwise(F.col("record")),
    )
    return merkle_warc.audited(first, materialize(damaged, "warc"))


URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def op8_url_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Verdict on every page's URL, by fixed rules and by rules mined from labels."""
    from emberfield.llm.url_rules import judge

    return judge(_table(spark, folder, "pages"), _table(spark, folder, "labels"), URL_RULES)


def op11_collocations(spark: SparkSession, folder: str) -> DataFrame:
    """The first 2000 collocations of two to three words per language, over all documents."""
    from emberfield.llm.collocations import collocations

    return collocations(_table(spark, folder, "documents"))


def op12_path_copying_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Merkle manifest of all documents, and the root that each document's tampered version ends in."""
    from emberfield.llm import path_manifest

    chars, key = F.col("n_chars"), F.col("doc_id").cast("string")
    picked = F.coalesce(F.crc32(key.cast("binary")) % 7 == 0, F.lit(False))
    # One more than the largest long is still written out in full.
    tampered = F.when(picked, (chars.cast("decimal(20,0)") + F.lit(1)).cast("string")).otherwise(chars.cast("string"))
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    return path_manifest.digests(
        path_manifest.manifest(_table(spark, folder, "documents"), "lang", "doc_id", fields, {"n_chars": tampered})
    )


def op13_disclosure_control(spark: SparkSession, folder: str) -> DataFrame:
    """Personal data in all documents, and the terms beside it that disclose it."""
    from emberfield.llm import disclosure

    docs = _table(spark, folder, "documents").select("doc_id", "text")
    return disclosure.digests(disclosure.private_spans(docs, "doc_id"), "doc_id")


#: Query name to function, for the driver contract.
QUERIES = {name: function for name, function in list(globals().items()) if name.startswith("op")}
#: Query name to DuckDB SQL over the same tables.
CHECKS = {
    "op2_chat_windows": r"""
        with t as (
            select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
            union all
            select -7, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'
        ), n as (
            select *, row_number() over w as number,
                len(regexp_extract_all(text, '\p{L}+|\p{N}+|[^ \t\n\r\f\x0B\p{L}\p{N}]')) + 4 as cost,
                len(role) + len(text) + 15
                    + len(text) - len(replace(replace(replace(text, '\', ''), '<', ''), '#', ''))
                    + len(role) - len(replace(replace(replace(replace(role, '\', ''), '<', ''), '#', ''), ':', '')) as chars
            from t window w as (partition by conv_id order by turn nulls first, role, text)
        ), m as (
            select *, number = 1 and role = 'system' as lead from n
        ), p as (
            select *, sum(case when lead then 0 else cost end) over (
                partition by conv_id order by number rows unbounded preceding) as stop from m
        ), q as (
            select *, stop - cost as start, 2 * ((stop - cost) // 1024) + cast(stop > ((stop - cost) // 1024 + 1) * 1024 as int) as win
            from p where not lead
        ), s as (
            select conv_id, win, min(start) as first from q group by all
        ), f as (
            select conv_id, chars from m
            union all
            select q.conv_id, q.chars from q join s on q.conv_id = s.conv_id and q.start >= s.first - 256 and q.stop <= s.first
            union all
            select m.conv_id, m.chars from m join s on m.conv_id = s.conv_id and m.lead and s.first > 0
        ), c as (
            select conv_id, cast(sum(chars) as bigint) as formatted_chars from f group by conv_id
        )
        select conv_id, count(*) as n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' order by number)) as turns_sha256,
            cast(coalesce(sum(len(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
            sha256(coalesce(string_agg(text, '' order by number) filter (role = 'assistant'), '')) as loss_sha256,
            any_value(formatted_chars) as formatted_chars
        from n join c using (conv_id) group by conv_id
    """,
    "op11_collocations": r"""
        with p as (
            select row_number() over () as piece, lang, regexp_extract_all(piece, '[^ \t]+') as w
            from (
                select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(
                    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n\x0B\f\r]')) as piece
                from documents where text is not null)
        ), w as (
            select piece, lang, unnest(w) as w1, unnest(range(len(w))) as i from p
        ), x as (
            select lang, w1, lead(w1) over q as w2, lead(w1, 2) over q as w3 from w window q as (partition by piece order by i)
        ), f as (
            select lang, 1 as k, w1 as phrase, w1, null as w2, null as w3, count(*)::hugeint as a from x group by all
            union all
            select lang, 2, w1 || ' ' || w2, w1, w2, null, count(*) from x where w2 is not null group by all having count(*) >= 10
            union all
            select lang, 3, w1 || ' ' || w2 || ' ' || w3, w1, w2, w3, count(*) from x where w3 is not null group by all having count(*) >= 10
        ), n as (
            select lang, sum(a)::bigint as n from f where k = 1 group by lang
        ), cuts as (
            select *, (lang, w1) as head, (lang, case k when 2 then w2 else w2 || ' ' || w3 end) as tail, 1 as cut from f where k > 1
            union all
            select *, (lang, w1 || ' ' || w2), (lang, w3), 2 from f where k = 3
        ), scored as (
            select c.lang, c.k, c.phrase, c.w1, c.w2, c.w3, c.a, l.a as l, r.a as r, (1000000 * c.a * c.a) // (l.a * r.a) as score
            from cuts c join f l on (l.lang, l.phrase) = c.head join f r on (r.lang, r.phrase) = c.tail
            qualify row_number() over (partition by c.lang, c.phrase order by score, c.cut) = 1
        ), inside as (
            select lang, phrase, max(a) as a from (
                select lang, a, unnest([w1 || ' ' || w2, w2 || ' ' || w3]) as phrase from f where k = 3) group by all
        ), kept as (
            select s.* from scored s left join inside i on i.lang = s.lang and i.phrase = s.phrase and s.k = 2
            where i.a is null or 100 * i.a < 50 * s.a
        )
        select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase,
            a::bigint as a, l::bigint as l, r::bigint as r, n, score::bigint as score
        from kept join n using (lang) qualify rank <= 2000
    """,
    "op12_path_copying_manifest": r"""
        with recursive f as (
            select doc_id, lang, n_chars,
                xor(list_reduce([4294967295::bigint] || [ascii(x)::bigint for x in string_split(doc_id::varchar, '')],
                    lambda c, b: list_reduce([xor(c, b)] || range(8), lambda x, k: xor(x >> 1, (x & 1) * 3988292384))), 4294967295) % 7 = 0 as picked,
                [coalesce(strlen(v) || ':' || v, '-') for v in [doc_id::varchar, source, lang]] as a,
                coalesce(strlen(text) || ':' || text, '-') as z
            from documents
        ), g as (
            select doc_id, lang, sha256(list_aggregate(a, 'string_agg', '') || coalesce(strlen(n_chars::varchar) || ':' || n_chars, '-') || z) as leaf,
                sha256(list_aggregate(a, 'string_agg', '') || coalesce(strlen(c::varchar) || ':' || c, '-') || z) as changed
            from (select *, case when coalesce(picked, false) then n_chars::hugeint + 1 else n_chars end as c from f)
        ), l as (
            select *, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as place, coalesce('+' || lang, '') as t from g
        ), up as (
            select 0 as level, t, place, leaf as h, count(*) over (partition by t) as n from l
            union all
            select level + 1, t, place // 2, sha256(string_agg(h, '' order by place)), any_value((n + 1) // 2)
            from up where n > 1 group by level, t, place // 2
        ), s as (
            select t, h, row_number() over (order by t) - 1 as place, count(*) over () as n from up where n = 1
        ), top as (
            select 0 as level, place, h, n from s
            union all
            select level + 1, place // 2, sha256(string_agg(h, '' order by place)), any_value((n + 1) // 2) from top where n > 1 group by level, place // 2
        ), heights as (
            select t, max(level) as height from up group by t
        ), path as (
            select l.doc_id, l.t, l.place, u.level, u.place as at, u.h from l join up u on u.t = l.t and u.n > 1 and u.place = xor(l.place >> u.level, 1)
            union all
            select l.doc_id, l.t, l.place, e.height + x.level, x.place, x.h
            from l join s using (t) join heights e using (t) join top x on x.n > 1 and x.place = xor(s.place >> x.level, 1)
        ), proofs as (
            select t, place, sha256(string_agg(h, '' order by level)) as proof from path group by t, place
        ), fold as (
            select l.t, l.place, 0 as level, l.changed as h, e.height + (select max(level) from top) as steps, e.height, s.place as own
            from l join heights e using (t) join s using (t)
            union all
            select f.t, f.place, f.level + 1,
                sha256(case when p.h is null then f.h
                    when ((case when f.level < f.height then f.place >> f.level else f.own >> (f.level - f.height) end) & 1) = 0 then f.h || p.h
                    else p.h || f.h end), f.steps, f.height, f.own
            from fold f left join path p on p.t = f.t and p.place = f.place and p.level = f.level where f.level < f.steps
        )
        select l.doc_id, l.leaf, s.h as subroot, r.h as root, coalesce(p.proof, sha256('')) as proof_sha256, d.h as folded_root, d.h = r.h as verified
        from l join s using (t) join (select h from top where n = 1) r on true left join proofs p on p.t = l.t and p.place = l.place
        join fold d on d.t = l.t and d.place = l.place and d.level = d.steps
    """,
    "op13_disclosure_control": r"""
        with d as (
            select row_number() over () as row, doc_id, coalesce(text, '') as text from documents
        ), p as (
            select * from (values (0, 'email', '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+'), (1, 'ip', '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)'),
                (2, 'card', '[0-9]([\x20-]?[0-9])+'), (3, 'phone', '\+[0-9][\x20().0-9-]+[0-9]')) as p(ord, kind, pattern)
        ), f as (
            select row, text, ord, kind, regexp_extract_all(text, pattern) as found, regexp_split_to_array(text, pattern) as pieces from d cross join p
        ), i as (
            select *, found[i] as v, regexp_replace(found[i], '[^0-9]', '', 'g') as digits,
                (list_sum([len(x) for x in pieces[1:i]]) + coalesce(list_sum([len(x) for x in found[1:i - 1]]), 0))::bigint as a
            from (select *, unnest(range(1, len(found) + 1)) as i from f)
        ), w as (
            select row, text, ord, kind, v, digits, a, a + len(v) as z,
                coalesce(lag(a + len(v)) over (partition by row, ord order by a), 0) as prev,
                coalesce(lead(a) over (partition by row, ord order by a), len(text)) as next
            from i where ord <> 2 or len(digits) between 12 and 19
        ), e as (
            select row, text, ord, kind, a, z, prev, next,
                kind || ':' || case when ord < 2 then translate(v, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') else digits end as entity,
                substr(text, greatest(prev, a - 80) + 1, a - greatest(prev, a - 80)) as lw, a - prev > 80 as lcut,
                substr(text, z + 1, least(next, z + 80) - z) as rw, next - z > 80 as rcut
            from w where case ord when 0 then true
                when 1 then len([x for x in string_split(v, '.') if len(ltrim(x, '0')) > 3 or try_cast(('0' || right(x, 3)) as int) > 255]) = 0
                when 2 then list_sum([case when k % 2 = 0 then substr(digits, len(digits) - k, 1)::int
                    else (2 * substr(digits, len(digits) - k, 1)::int) // 10 + (2 * substr(digits, len(digits) - k, 1)::int) % 10 end
                    for k in range(len(digits))]) % 10 = 0
                else len(digits) between 9 and 15 end
        ), side as (
            select row, entity, lw, rw, a - len(lw) as base, lw as win, lcut as cut_a, false as cut_z from e
            union all
            select row, entity, lw, rw, z, rw, false, rcut from e
        ), t as (
            select *, found[i] as v, (list_sum([len(x) for x in pieces[1:i]]) + coalesce(list_sum([len(x) for x in found[1:i - 1]]), 0))::bigint as a
            from (select *, unnest(range(1, len(found) + 1)) as i from (
                select *, regexp_extract_all(win, '\p{L}+') as found, regexp_split_to_array(win, '\p{L}+') as pieces from side))
        ), near as (
            select row, entity, lw, rw, base + a as a, base + a + len(v) as z, translate(v, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as term
            from t where not (cut_a and a = 0) and not (cut_z and a + len(v) = len(win))
        ), pairs as (
            select entity, form, count(distinct row) as together, count(distinct (lw, rw)) as contexts
            from (select *, unnest([term] || case when len(term) > 3 then [left(term, 3) || '*'] else [] end) as form from near)
            group by all having count(distinct (lw, rw)) >= 3
        ), counts as (
            select form, count(*) as n from (
                select unnest(list_distinct(x || [left(y, 3) || '*' for y in x if len(y) > 3])) as form
                from (select regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '\p{L}+') as x from d)) group by form
        ), holders as (
            select entity, count(distinct row) as held from e group by entity
        ), strong as (
            select entity, form from pairs join holders using (entity) join counts using (form) cross join (select count(*) as total from d)
            where held < total and ln(together::double / n) >= (0.9::double - 1) * ln(total::double / held)
        ), told as (
            select s.entity, s.form as term, g.form is null and len(s.form) > 3 as general
            from strong s left join strong g on g.entity = s.entity and g.form = left(s.form, 3) || '*' where s.form not like '%*'
        ), hits as (
            select row, a, z, bool_and(general) as general from near join told using (entity, term) group by row, a, z
        ), spans as (
            select row, ord, kind, a, z from e
            union all
            select row, case when general then 4 else 5 end, case when general then 'general' else 'remove' end, a, z from hits h
            where not exists (select 1 from e where e.row = h.row and h.a < e.z and e.a < h.z)
        ), s as (
            select row, count(*) filter (ord = 0) as n_email, count(*) filter (ord = 1) as n_ip, count(*) filter (ord = 2) as n_card, count(*) filter (ord = 3) as n_phone,
                string_agg(kind || ':' || a || ':' || z, ',' order by a, ord, z) filter (ord < 4) as base, string_agg(kind || ':' || a || ':' || z, ',' order by a, ord, z) as spans
            from spans group by row
        )
        select doc_id, coalesce(n_email, 0) as n_email, coalesce(n_ip, 0) as n_ip, coalesce(n_card, 0) as n_card, coalesce(n_phone, 0) as n_phone,
            sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
        from d left join s using (row)
    """,
    "op7_merkle_fixity": r"""
        with r as (
            select page_id, cast(floor(page_id / 512) as bigint) as file,
                'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:'
                || page_id || '>' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10)
                || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || strlen(coalesce(html, ''))
                || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) as rec
            from pages
        )
        select page_id, file, cast(strlen(rec) as bigint) as length, sha256(rec) as record_sha256,
            cast(coalesce(sum(strlen(rec)) over (
                partition by file order by page_id rows between unbounded preceding and 1 preceding), 0) as bigint) as "offset",
            case page_id % 101 when 7 then 'altered' when 8 then 'missing' else 'ok' end as status
        from r
    """,
    "op8_url_rules": r"""
        with u as (
            select page_id, url,
                case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) end as rest from pages
        ), h as (
            select page_id, url,
                translate(coalesce(regexp_extract(rest, '^([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
                coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') as path from u
        ), k as (
            select *, case when host = '' then [] else list_sort(list_distinct(
                ['scheme ' || lower(split_part(url, '://', 1))]
                || [('host ' || x) for x in string_split(host, '.') if x <> '']
                || [('path ' || x) for x in regexp_split_to_array(path, '[/._-]') if x <> '' and not regexp_full_match(x, '[0-9]+')]
                || (case when path like '%/' then ['end /'] else [] end)
                || [('key ' || split_part(x, '=', 1)) for x in string_split(regexp_extract(url, '\?([^#]*)', 1), '&') if x <> '']
                || (case when instr(url, '#') > 0 then ['fragment'] else [] end))) end as toks,
                try_cast(regexp_extract(path, '([0-9]+)[^0-9]*$', 1) as bigint) as doc_id from h
        ), l as (
            select doc_id, max(coalesce(quality, 1) = 0 or coalesce(toxic, 0) = 1) as bad from labels where doc_id is not null group by doc_id
        ), g as (
            select toks, bad from k join l using (doc_id) where len(toks) > 0
        ), b as (
            select [toks[i + 1] for i in range(len(toks)) if (m >> i) & 1 = 1] as part, bad
            from (select toks, bad, unnest(range(1, 1 << len(toks))) as m from g)
        ), z as (
            select greatest(20, ceil(count(*) * 0.005)) as least, count(*) as n from g
        ), rules as (
            select part, count(*) filter (bad) / count(*) as confidence from b, z group by part, least, n
            having count(*) filter (bad) >= least and count(*) filter (bad) / count(*) >= 0.6 and n >= 20
        ), d as (
            select toks, max(confidence) as confidence from (select distinct toks from k) t join rules on list_has_all(toks, part) group by toks
        ), j as (
            select k.*, d.confidence,
                case when ('.' || host) like '%.example.net' and path like '/en/%' then 'example.net/en/'
                    when ('.' || host) like '%.example.com' and path like '/de/%' then 'example.com/de/'
                    when ('.' || host) like '%.org' and path like '/fr/%' then 'org/fr/'
                    when ('.' || host) like '%.net' and path like '/%' then 'net/' end as rule
            from k left join d using (toks)
        )
        select page_id, host, path, rule, confidence,
            case when rule in ('example.net/en/', 'org/fr/') then 'allow' when rule is not null then 'block'
                when confidence is not null then 'block' else 'allow' end as verdict
        from j
    """,
}
