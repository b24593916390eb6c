"""DuckDB SQL for the corpus queries that SQL can express, written from the contracts and not from the Spark plans."""

from __future__ import annotations

from wicker.llm.chat import CONTROLS, ChatFormat


def either_case(words: str) -> str:
    """A pattern for words in either case of ASCII letters alone: (?i) would also take letters that fold to them."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words)


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def crc32(data: str) -> str:
    """SQL for the CRC-32 of a blob: bytes from its hex digits, the table of 256 entries by rule."""
    table = "list_transform(range(256), lambda t: list_reduce(list_prepend(t, range(8)), lambda c, b: if(c & 1 = 1, xor(c >> 1, 3988292384::bigint), c >> 1)))"
    octets = f"list_transform(range(1, length(hex({data})), 2), lambda p: ('0x' || substr(hex({data}), p, 2))::bigint)"
    step = "lambda c, b: xor(c >> 8, tab[xor(c & 255, b) + 1])"
    return f"(select xor(list_reduce(list_prepend(4294967295::bigint, octets), {step}), 4294967295::bigint) from (select {table} as tab, {octets} as octets))"


def chat_windows(how: ChatFormat = ChatFormat()) -> str:
    """Turns in order, their escaped lengths, and the windows one turn at a time for all conversations at once."""
    added = " + ".join(f"(length(v) - length(replace(v, {quoted(c)}, ''))) // {len(c)}" for c in ["\\", *CONTROLS])
    escaped = lambda v: f"(length({v}) + {added.replace('(v', '(' + v)})"
    marks = sum(map(len, CONTROLS[:3]))
    return f"""
    with recursive said as (
        select conv_id, turn, role, text from conversations
        union all select -1, 0, 'user', '</s>[INST] ok [/INST]'
        union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
    turns as (
        select conv_id, coalesce(role, '') as r, coalesce(text, '') as x,
            row_number() over (partition by conv_id order by turn nulls first, r, x) - 1 as i from said),
    sized as (
        select *, len(regexp_extract_all(x, '\\p{{L}}+|\\p{{N}}|[^ \\t\\n\\x0B\\f\\r\\p{{L}}\\p{{N}}]')) + 3 as n,
            {marks} + {escaped('r')} + {escaped('x')} as l from turns),
    whole as (
        select conv_id, count(*) as size, list(n order by i) as n, list(l order by i) as l,
            if(first(r order by i) = 'system' and count(*) > 1, 1, 0) as sys,
            string_agg(r || chr(10) || x || chr(10), '' order by i) as said,
            coalesce(string_agg(x, '' order by i) filter (where r = 'assistant'), '') as loss
        from sized group by conv_id),
    walk as (
        select conv_id, size, n, l, sys, said, loss, 1 as i, 0 as came, 0 as hist, list_sum(l)::bigint as chars from whole
        union all
        select conv_id, size, n, l, sys, said, loss, i + 1, if(fits, came, i), if(fits, hist, h),
            if(fits, chars, chars + sys * l[1] + coalesce(list_sum(l[h + 1:i]), 0)::bigint)
        from (select *,
                list_sum(n[hist + 1:i + 1]) + if(came = 0, 0, sys * n[1]) <= {how.budget} as fits,
                list_filter(range(greatest(sys, i - {how.history_turns}), i + 1), lambda k:
                    k = i or list_sum(n[k + 1:i]) <= least({how.history_tokens}, {how.budget} - sys * n[1] - n[i + 1]))[1] as h
            from walk where i < size))
    select conv_id, size::bigint as n_turns, sha256(said) as turns_sha256, length(loss)::bigint as loss_chars,
        sha256(loss) as loss_sha256, chars as formatted_chars
    from walk where i = size"""


MEDIA_PAYLOADS = f"""
    with whole as (
        select doc_id, encode(coalesce(text, '')) as b, octet_length(b) as n_bytes,
            greatest(64, (n_bytes + 63) // 64 * 64) as payload_bytes,
            b || unhex(repeat('00', (payload_bytes - n_bytes)::int)) as payload from documents)
    select doc_id, n_bytes::bigint as n_bytes, payload_bytes::bigint as payload_bytes, sha256(payload) as payload_sha256,
        {crc32('payload[payload_bytes - 63:payload_bytes]')} as tail_crc32
    from whole"""


def secret_base_spans() -> str:
    """Matches and the gaps between them give positions; those that fail are dropped afterwards."""
    words = either_case("password|passwd|secret|token|api_?key")
    assign = f"""({words})["']?\\x20*[:=]\\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    kinds = [("assign", assign, f"length(regexp_extract(m, {quoted(assign)}, 2)) >= 8"), ("access", "AKIA[A-Z0-9]+", "length(m) >= 16"), ("hex", "[0-9a-f]+", "length(m) >= 32")]
    each = " union all ".join(
        f"select row, {k} as k, '{name}' as kind, unnest(found) as m, unnest(gaps[:-2]) as g, unnest(range(len(found))) as i "
        f"from (select row, regexp_extract_all(x, {quoted(p)}) as found, list_transform(regexp_split_to_array(x, {quoted(p)}), lambda z: length(z)) as gaps from docs where regexp_matches(x, {quoted(p)}))"
        for k, (name, p, _) in enumerate(kinds))
    keep = " or ".join(f"(kind = '{name}' and {c})" for name, _, c in kinds)
    return f"""
    with docs as (select row_number() over () as row, doc_id, coalesce(text, '') as x from documents),
    found as ({each}),
    placed as (
        select *, (sum(g + length(m)) over (partition by row, k order by i))::bigint as e, e - length(m) as s from found),
    kept as (
        select row, count(*) filter (where k = 0) as a, count(*) filter (where k = 1) as c, count(*) filter (where k = 2) as h,
            string_agg(kind || ':' || s || ':' || e, ',' order by s, k) as spans
        from placed where {keep} group by row)
    select doc_id, coalesce(a, 0)::bigint as n_assign, coalesce(c, 0)::bigint as n_access, coalesce(h, 0)::bigint as n_hex,
        sha256(coalesce(spans, '')) as base_sha256
    from docs left join kept using (row)"""


EMBEDDING_GROUPS = """
    with recursive rows as (select row_number() over () as row, vec_id, embedding::double[] as v from embeddings),
    fine as (
        select row, vec_id, list_transform(v, lambda x: coalesce(x, 0)) as v from rows
        where vec_id is not null and len(v) > 0 and len(list_filter(v, lambda x: x is null or not isfinite(x))) = 0
            and len(list_filter(v, lambda x: x <> 0)) > 0),
    links as (
        select a.row, a.vec_id, b.row as other, b.vec_id as other_id from fine a join fine b
        on a.row <> b.row and len(a.v) = len(b.v) and list_cosine_similarity(a.v, b.v) >= 0.9),
    reach as (
        select row, row as other, vec_id as other_id from fine
        union select reach.row, links.other, links.other_id from reach join links on links.row = reach.other),
    near as (select row, count(*) as n from links group by row),
    least as (select row, min(other_id) as component_id from reach group by row)
    select vec_id, coalesce(n, 0)::bigint as n_links, coalesce(component_id, vec_id) as component_id,
        vec_id is not distinct from coalesce(component_id, vec_id) as kept
    from rows left join near using (row) left join least using (row)"""


HELD_OUT = f"select doc_id, if(doc_id is null, null, {crc32('encode(doc_id::varchar)')} % 3 = 1) as held_out from documents"


def merkle_manifest() -> str:
    """Levels of both trees by recursion; a path's runs, each led by the place in it, are folded as a list."""
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    value = lambda v: f"coalesce(octet_length(encode({v}::varchar)) || ':' || {v}::varchar, '-')"
    digest = lambda text: "sha256(" + " || ".join(map(value, ("doc_id", "source", "lang", "n_chars", text))) + ")"
    level = "level + 1, i // 16, (any_value(n) + 15) // 16, sha256(string_agg(d, '' order by i))"
    place = "lpad(((x.{0} // (16 ** r.level)::bigint) % 16)::varchar, 2, '0') || r.run"
    return f"""
    with recursive leaves as (
        select row_number() over () as row, doc_id, source, {digest('text')} as leaf,
            if({crc32('encode(doc_id::varchar)')} % 5 = 0, {digest(lower)}, leaf) as claim from documents),
    placed as (
        select *, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as i,
            count(*) over (partition by source) as n, dense_rank() over (order by source nulls first) - 1 as g from leaves),
    tree(g, level, i, n, d) as (
        select g, 0, i, n, leaf from placed
        union all select g, {level} from tree where n > 1 group by g, level, i // 16),
    subroots as (select g, d from tree where n = 1),
    tops(level, i, n, d) as (
        select 0, g, count(*) over (), d from subroots
        union all select {level} from tops where n > 1 group by level, i // 16),
    runs as (select g, level, i // 16 as j, string_agg(d, '' order by i) as run from tree where n > 1 group by all),
    top_runs as (select level, i // 16 as j, string_agg(d, '' order by i) as run from tops where n > 1 group by all),
    steps as (
        select row, list(s order by tier, level) as path from (
            select row, 0 as tier, level, {place.format('i')} as s
            from placed x join runs r on r.g = x.g and r.j = x.i // (16 ** (r.level + 1))::bigint
            union all select row, 1, level, {place.format('g')} from placed x join top_runs r on r.j = x.g // (16 ** (r.level + 1))::bigint)
        group by row)
    select doc_id, leaf, subroots.d as subroot, tops.d as root,
        sha256(array_to_string(list_transform(coalesce(path, []), lambda s: s[3:2 + 64 * s[:2]::int] || s[67 + 64 * s[:2]::int:]), '')) as proof_sha256,
        list_reduce(list_prepend(coalesce(claim, leaf), coalesce(path, [])), lambda d, s: sha256(s[3:2 + 64 * s[:2]::int] || d || s[67 + 64 * s[:2]::int:])) as folded_root,
        folded_root = tops.d as verified
    from placed join subroots using (g) join tops on tops.n = 1 left join steps using (row)"""


PREFIX_TRIE = f"""
    with turns as (
        select conv_id as c, sha256(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, '')) as mark,
            length(coalesce(text, ''))::bigint as chars, row_number() over (partition by conv_id order by turn nulls first, mark) as i
        from conversations where conv_id is not null),
    convs as (select distinct c, c - c % 100 as base, {crc32('encode(c::varchar)')} % 6 as h from turns),
    parts as (
        select v.c, 0 as own, t.i, mark, chars from convs v join turns t on t.c = base and t.i <= h
        union all select c, 1, i, mark, chars from convs join turns using (c) where i > h),
    placed as (select *, row_number() over (partition by c order by own, i) as d from parts),
    paths as (
        select c, d, chars, string_agg(mark, '' order by d) over (partition by c order by d) as key, max(d) over (partition by c) = d as last from placed
        union all select c, 0, 0, '', c not in (select c from placed) from convs),
    nodes as (
        select key, d, min(c) as conv_id, count(*) as n, any_value(chars) as chars, if(d = 0, null, key[:-65]) as up,
            sha256(coalesce(string_agg(c::varchar, ',' order by c) filter (where last), '')) as ends from paths group by key, d),
    degrees as (select up as key, count(*) as k from nodes where d > 0 group by up),
    under as (
        select p.key, u.n, u.chars, u.d, k from nodes u join paths p on p.c = u.conv_id and p.d <= u.d
        left join degrees on degrees.key = u.key),
    sums as (
        select key, count(*) filter (where k is null) as leaves, sum(if(d = 0, 0, (n - 1) * chars)) as saved from under group by key)
    select x.conv_id, x.d::bigint as depth, p.conv_id as parent_conv_id, x.n::bigint as n_convs, coalesce(k, 0)::bigint as n_children,
        leaves::bigint as n_leaves, saved::bigint as saved_tokens, x.ends as ends_sha256
    from nodes x left join nodes p on p.key = x.up left join degrees on degrees.key = x.key join sums on sums.key = x.key"""


WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

BENCHMARK_LEAKS = f"""
    with items as (select item_id, {WORDS} as w from benchmark),
    windows as (
        select distinct item_id, size, array_to_string(w[k:k + size - 1], ' ') as said
        from (select *, unnest(range(1, len(w) - size + 2)) as k from (select *, least(10, len(w)) as size from items where len(w) > 0))),
    docs as (select row_number() over () as row, doc_id, {WORDS} as w from documents),
    each as (select row, unnest(w) as word, unnest(range(1, len(w) + 1)) as k, len(w) as n from docs),
    places as (
        select row, size, k, said from (
            select row, size, k, n, string_agg(word, ' ') over (partition by row, size order by k rows between current row and size - 1 following) as said
            from each, (select distinct size from windows))
        where k + size - 1 <= n),
    met as (select row, k, size, item_id from places join windows using (size, said)),
    hits as (select row, count(distinct p) as n from (select row, unnest(range(k, k + size)) as p from met) group by row),
    whose as (
        select row, count(*) as n, string_agg(i, ',' order by i) as ids
        from (select distinct row, item_id::varchar as i from met where item_id is not null) group by row)
    select doc_id, len(w)::bigint as n_words, coalesce(hits.n, 0)::bigint as n_hit, coalesce(whose.n, 0)::bigint as n_items,
        sha256(coalesce(ids, '')) as items_sha256, coalesce(hits.n, 0) > 0 as contaminated
    from docs left join hits using (row) left join whose using (row)"""


ORACLE = {"op1_chat_windows": chat_windows(), "op8_embedding_groups": EMBEDDING_GROUPS, "media_payloads": MEDIA_PAYLOADS, "secret_base_spans": secret_base_spans(), "quality_held_out": HELD_OUT, "op11_merkle_manifest": merkle_manifest(), "op12_prefix_trie": PREFIX_TRIE, "op13_benchmark_leaks": BENCHMARK_LEAKS}
