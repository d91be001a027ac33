"""Expected rows of those training-data queries that SQL can express."""

from __future__ import annotations

# crc32 of a decimal number, bit by bit.
CRC32 = """
    xor(4294967295, list_reduce(list_prepend(4294967295::bigint,
        list_transform(string_split({0}::varchar, ''), lambda ch: ascii(ch)::bigint)),
      lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), list_transform(range(8), lambda i: 0::bigint)),
        lambda a, z: case when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end)))"""

PREFIX_TRIE = f"""
    with own as (
      select conv_id, list({{'role': ifnull(role, ''), 'text': ifnull("text", '')}} order by turn nulls first) as turns
      from conversations where conv_id is not null group by conv_id),
    rebuilt as (
      select o.conv_id, list_concat(ifnull(b.turns[1:o.h], []), o.turns[o.h + 1:]) as turns
      from (select *, {CRC32.format("conv_id")} % 6 as h from own) o
        left join own b on b.conv_id = o.conv_id - o.conv_id % 100),
    steps as (
      select conv_id, unnest(range(len(turns) + 1)) as depth, turns from rebuilt),
    nodes as (
      select turns[1:depth] as path, depth, min(conv_id) as conv_id, count(*) as n_convs,
        ifnull(string_agg(conv_id::varchar, ',' order by conv_id) filter (where len(turns) = depth), '') as ends
      from steps group by all),
    kids as (select path[1:depth - 1] as path, count(*) as n_children from nodes where depth > 0 group by all),
    whole as (
      select n.*, ifnull(k.n_children, 0) as n_children,
        if(depth = 0, 0, (n_convs - 1) * length(n.path[depth].text)) as saved
      from nodes n left join kids k on k.path = n.path),
    above as (
      select path[1:up] as path, sum(if(n_children = 0, 1, 0)) as n_leaves, sum(saved) as saved_tokens
      from (select *, unnest(range(depth + 1)) as up from whole) group by path[1:up])
    select w.conv_id, w.depth, p.conv_id as parent_conv_id, w.n_convs, w.n_children,
      a.n_leaves::bigint as n_leaves, a.saved_tokens::bigint as saved_tokens, sha256(w.ends) as ends_sha256
    from whole w join above a on a.path = w.path
      left join nodes p on w.depth > 0 and p.depth = w.depth - 1 and p.path = w.path[1:w.depth - 1]"""

USABLE = "embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0"

TOP_K = f"""
    with whole as (
      select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)) as v
      from embeddings where {USABLE} and vec_id is not null),
    scored as (
      select q.vec_id as query_id, c.vec_id, list_dot_product(q.v, c.v)::bigint as score
      from whole q join whole c on c.vec_id <> q.vec_id where q.vec_id % 20 = 0)
    select query_id, (row_number() over (partition by query_id order by score desc, vec_id))::int as rank, vec_id, score
    from scored qualify rank <= 20"""


def _vector_codes(rounds: int = 4) -> str:
    """Rounds of assignment and means, one after the other."""
    steps = [
        f"""whole as materialized (
          select vec_id, label, row_number() over (order by vec_id nulls last) as place,
            list_transform(embedding, lambda x: floor(1024 * x::double)) as v
          from embeddings where {USABLE})""",
        """pieces as materialized (
          select place, part, v[part * len(v) // 4 + 1:(part + 1) * len(v) // 4] as x
          from whole, (select unnest(range(4)) as part))""",
        "book0 as materialized (select part, place - 1 as entry, x as e from pieces where place <= 256)",
    ]
    for done in range(rounds + 1):
        steps.append(f"""coded{done} as materialized (
          select place, part, any_value(x) as x, min(row(d, entry)) as best
          from (select p.place, p.part, p.x, b.entry,
              list_dot_product(p.x, p.x) - 2 * list_dot_product(p.x, b.e) + list_dot_product(b.e, b.e) as d
            from pieces p join book{done} b on b.part = p.part) group by place, part)""")
        if done < rounds:
            steps.append(f"""means{done} as (
              select part, entry, list(m order by i) as e from (
                select part, entry, i, floor(sum(x[i]) / count(*)) as m
                from (select part, best[2] as entry, x, unnest(range(1, len(x) + 1)) as i from coded{done})
                group by part, entry, i) group by part, entry)""")
            steps.append(f"""book{done + 1} as materialized (
              select b.part, b.entry, ifnull(m.e, b.e) as e
              from book{done} b left join means{done} m on m.part = b.part and m.entry = b.entry)""")
    steps.append(f"""found as (
      select place, string_agg(printf('%02x', best[2]), '' order by part) as code, sum(best[1])::bigint as error
      from coded{rounds} group by place)""")
    return f"""
    with {", ".join(steps)}
    select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error,
      (select sha256(string_agg(array_to_string(list_transform(e, lambda x: x::bigint), ','), ',' order by part, entry))
       from book{rounds}) as codebooks_sha256
    from whole join found using (place)"""


# The smallest number that links lead to, from every node to itself on.
REACH = """
    reach(id, found) as (
      select id, id from nodes
      union
      select r.id, e.b from reach r join edges e on e.a = r.found),
    classes as (select id, min(found) as class_id from reach group by id)"""

# Fixed by the contract: shingles of five words, a similarity of 0.8. All pairs that share a shingle, by hashes of 64 bits.
JACCARD = f"""
    with recursive words as (
      select doc_id, "text", list_filter(string_split_regex("text", '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') as w
      from documents where doc_id is not null),
    nodes as (
      select min(doc_id) as id, count(distinct doc_id) as copies, "text", any_value(w) as w
      from words where len(w) > 0 group by "text"),
    shingles as (
      select distinct id, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1),
        lambda i: hash(array_to_string(w[i:i + 4], ' ')))) as s
      from nodes),
    sizes as (select id, count(*) as n from shingles group by id),
    common as (
      select x.id as a, y.id as b, count(*) as c from shingles x join shingles y on x.s = y.s and x.id <> y.id group by all),
    edges as (
      select a, b from common join sizes x on x.id = a join sizes y on y.id = b where 10 * c >= 8 * (x.n + y.n - c)),
    {REACH},
    links as (select a as id, sum(n.copies) as links from edges join nodes n on n.id = b group by a)
    select d.doc_id, ifnull(c.class_id, d.doc_id) as class_id,
      (ifnull(l.links, 0) + ifnull(n.copies, 1) - 1)::bigint as n_links, d.doc_id = ifnull(c.class_id, d.doc_id) as kept
    from documents d left join nodes n on n."text" = d."text" left join classes c on c.id = n.id left join links l on l.id = n.id
    where d.doc_id is not null"""

# Fixed by the contract: a cosine of 0.93. All pairs of a label.
COSINE = f"""
    with recursive nodes as (
      select vec_id as id, label, v, sqrt(list_dot_product(v, v)) as size
      from (select *, list_transform(embedding, lambda x: x::double) as v from embeddings where {{usable}} and len(embedding) > 0)
      where label is not null and vec_id is not null and list_dot_product(v, v) > 0),
    edges as (
      select x.id as a, y.id as b from nodes x join nodes y on x.label = y.label and x.id <> y.id and len(x.v) = len(y.v)
      where list_dot_product(x.v, y.v) / (x.size * y.size) >= 0.93),
    {REACH},
    links as (select a as id, count(*) as n_links from edges group by a)
    select vec_id, ifnull(n_links, 0) as n_links, ifnull(class_id, vec_id) as component_id,
      vec_id = ifnull(class_id, vec_id) as kept
    from embeddings left join classes on classes.id = vec_id left join links on links.id = vec_id"""


def llm_oracles() -> dict[str, str]:
    """SQL by query. The others learn, tokenize or draw, which SQL cannot state."""
    return {
        "op7_jaccard_join": JACCARD,
        "op10_lattice": COSINE.format(usable=USABLE),
        "op11_prefix_trie": PREFIX_TRIE,
        "op12_block_search": TOP_K,
        "op13_vector_codes": _vector_codes(),
    }
