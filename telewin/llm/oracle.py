"""SQL of another engine for operators whose result it can follow step by step."""

_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def similar_documents(k: int, percent: int, columns: str) -> str:
    """``columns`` (of ``doc_id, n_shingles, component_id``) from all pairs of sets of ``k``-word shingles that share a shingle."""
    return rf"""
        with recursive words as (
            select doc_id, regexp_extract_all({_LOWERED}, '[^\x20\x09-\x0D]+') as w from documents
        ),
        sets as (
            select doc_id, list_sort(list_distinct(case
                when len(w) = 0 then [] when len(w) < {k} then [array_to_string(w, ' ')]
                else list_transform(range(1, len(w) - {k} + 2), lambda i: array_to_string(w[i : i + {k - 1}], ' ')) end)) as s
            from words
        ),
        reps as (select s, min(doc_id) as rep, len(s) as n from sets where len(s) > 0 group by s),
        grams as (select rep, n, unnest(s) as g from reps),
        pairs as (
            select a.rep as u, b.rep as v, any_value(a.n + b.n) as n, count(*) as shared
            from grams a join grams b on a.g = b.g and a.rep < b.rep
                and 100 * least(a.n, b.n) >= {percent} * greatest(a.n, b.n)
            group by a.rep, b.rep
        ),
        links as (select u, v from pairs where 100 * shared >= {percent} * (n - shared)),
        both_ways as (select u, v from links union all select v, u from links),
        reached as (
            select rep as u, rep as v from reps
            union select r.u, b.v from reached r join both_ways b on r.v = b.u
        ),
        roots as (select u, min(v) as root from reached group by u),
        classes as (select s, root from reps join roots on rep = u),
        found as (
            select sets.doc_id, cast(len(sets.s) as bigint) as n_shingles, coalesce(classes.root, sets.doc_id) as component_id
            from sets left join classes on sets.s = classes.s
        )
        select {columns} from found
    """


def vector_codes(parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> str:
    """Lloyd's rounds, one after the other."""
    square = "list_inner_product({0}, {0})"
    steps = []
    for r in range(rounds + 1):
        far = f"{square.format('x.v')} + {square.format('b.c')} - 2 * list_inner_product(x.v, b.c)"
        steps.append(f"""
        near{r} as materialized (
            select rid, p, any_value(v) as v, min(far) as far, arg_min(e, (far, e)) as e
            from (select x.rid, x.p, x.v, b.e, {far} as far from parts x join book{r} b on x.p = b.p) group by rid, p
        )""")
        if r < rounds:
            steps.append(f"""
        sums{r} as (
            select p, e, i, sum(t) as s, count(*) as n
            from (select p, e, unnest(cast(v as bigint[])) as t, unnest(range(len(v))) as i from near{r}) group by p, e, i
        ),
        means{r} as (select p, e, list(cast((s - ((s % n) + n) % n) // n as double) order by i) as c from sums{r} group by p, e),
        book{r + 1} as materialized (
            select b.p, b.e, coalesce(m.c, b.c) as c from book{r} b left join means{r} m on b.p = m.p and b.e = m.e
        )""")
    return f"""
        with kept as materialized (
            select row_number() over (order by vec_id) as rid, vec_id, label,
                   list_transform(embedding, lambda x: floor({scale} * cast(x as double))) as x
            from (select * from embeddings where embedding is not null)
            where len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
        ),
        parts as materialized (
            select rid, p, x[p * len(x) // {parts} + 1 : (p + 1) * len(x) // {parts}] as v
            from kept, (select unnest(range({parts})) as p)
        ),
        book0 as materialized (select p, rid - 1 as e, v as c from parts where rid <= {entries}),
        {",".join(steps)},
        codes as (
            select k.rid, any_value(vec_id) as vec_id, any_value(label) as label,
                   string_agg(format('{{:02x}}', e), '' order by p) as code, cast(sum(far) as bigint) as error
            from kept k join near{rounds} n on k.rid = n.rid group by k.rid
        ),
        flat as (select p, e, unnest(cast(c as bigint[])) as t, unnest(range(len(c))) as i from book{rounds})
        select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error,
               (select sha256(string_agg(cast(t as varchar), ',' order by p, e, i)) from flat) as codebooks_sha256
        from codes
    """


_CRC32 = """xor(list_reduce(
    flatten(list_transform(string_split(cast(doc_id as varchar), ''), lambda c: [cast(ascii(c) as bigint), 0, 0, 0, 0, 0, 0, 0])),
    lambda crc, x: case when xor(crc, x) % 2 = 1 then xor(xor(crc, x) // 2, 3988292384) else xor(crc, x) // 2 end,
    cast(4294967295 as bigint)), 4294967295)"""


def _leaf(text: str) -> str:
    fields = [f"coalesce(strlen({c}) || ':' || {c}, '-')" for c in ("cast(doc_id as varchar)", "source", "lang", "cast(n_chars as varchar)", text)]
    return f"sha256({' || '.join(fields)})"


def _levels(name: str, base: str) -> str:
    """All nodes above ``base`` (``tree, place, digest, n``, the last being the nodes of the level), and their runs."""
    return f"""
        {name} as (
            select tree, cast(0 as bigint) as level, place, digest, n from {base}
            union all
            select tree, level + 1, place // 3, sha256(string_agg(digest, '' order by place)), (any_value(n) + 2) // 3
            from {name} where n > 1 group by tree, level, place // 3
        ),
        {name}_runs as (
            select tree, level, place // 3 as run, list(digest order by place) as run_digests from {name} where n > 1
            group by tree, level, place // 3
        )"""


def _walk(name: str, start: str, runs: str) -> str:
    """From ``start`` (``rid, tree, place, proof, node``) to the top of the tree; the last row of each leaf counts."""
    at = "w.place % 3"
    return f"""
        {name} as (
            select rid, tree, cast(0 as bigint) as level, place, proof, node from {start}
            union all
            select w.rid, w.tree, w.level + 1, w.place // 3,
                   w.proof || array_to_string(list_concat(run_digests[1 : {at}], run_digests[{at} + 2 :]), ''),
                   sha256(array_to_string(list_concat(list_append(run_digests[1 : {at}], w.node), run_digests[{at} + 2 :]), ''))
            from {name} w join {runs} r on w.tree = r.tree and w.level = r.level and w.place // 3 = r.run
        )"""


def manifest() -> str:
    return f"""
        with recursive docs as (
            select *, {_leaf("text")} as leaf,
                   {_leaf("case when " + _CRC32 + " % 2 = 0 then replace(text, chr(10), '') else text end")} as tampered
            from documents
        ),
        base as materialized (
            select row_number() over () as rid, doc_id, leaf, tampered, leaf as digest,
                   dense_rank() over (order by source nulls first) - 1 as tree,
                   row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as place,
                   count(*) over (partition by source) as n
            from docs
        ),
        {_levels("nodes", "base")},
        subroots as materialized (select tree as place, digest, -1 as tree, count(*) over () as n from nodes where n = 1),
        {_levels("tops", "subroots")},
        low as (select rid, tree, place, '' as proof, tampered as node from base),
        {_walk("walked", "low", "nodes_runs")},
        half as (
            select rid, -1 as tree, any_value(tree) as place, arg_max(proof, level) as proof, arg_max(node, level) as node
            from walked group by rid
        ),
        {_walk("climbed", "half", "tops_runs")},
        found as (select rid, arg_max(proof, level) as proof, arg_max(node, level) as node from climbed group by rid),
        whole as (select digest as root from tops where n = 1)
        select doc_id, leaf, s.digest as subroot, root, sha256(proof) as proof_sha256, node as folded_root, node = root as verified
        from base b join found f on b.rid = f.rid join subroots s on b.tree = s.place, whole
    """
