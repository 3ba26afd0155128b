"""DuckDB SQL for the operators that SQL can express: sharding, near-duplicates by comparing all sets that share a
shingle, lexical search by scoring all documents, and the prefix trie by grouping whole prefixes."""

from __future__ import annotations

from querent.llm.shard_tree import DIGITS, Tree

_CRC_TABLE = "crc_table as (select list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as t)"
_CRC = f"""{_CRC_TABLE},
bytes as (select doc_id, octet_length(encode(text)) + 16 as size, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: cast('0x' || h as bigint)) as b from (select doc_id, coalesce(text, '') as text from documents)),
sized as (select doc_id, cast(size as bigint) as size, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) as text_crc32 from bytes, crc_table)"""


def _pick(level: int, nodes: dict[int, float]) -> str:
    draw = lambda n, w: f"struct_pack(d := -ln((cast('0x' || substr(md5('{level}:{n}:' || k), 1, {DIGITS}) as bigint)::double + 0.5) / {float(16**DIGITS):.1f}) / {w}, n := {n})"
    return f"list_sort([{', '.join(draw(n, w) for n, w in nodes.items())}])[1].n" if len(nodes) > 1 else str(next(iter(nodes)))


def _descend(tree: Tree, source: str, out: str) -> str:
    """Three nested selects, one a level, that add the column out to source."""
    step = lambda level, parents: "case node " + " ".join(f"when {p} then {_pick(level, tree.children(level, p))}" for p in parents) + " end"
    top = f"(select *, {_pick(0, tree.children(0, None))} as node from {source})"
    racks = f"(select * exclude (node), {step(1, tree.children(0, None))} as node from {top})"
    return f"(select * exclude (node), cast({step(2, {leaf[1]: 0 for leaf in tree.leaves})} as int) as {out} from {racks})"


def hash_tree(shards: int = 40, buckets: int = 8) -> str:
    keyed = "(select *, coalesce(cast(doc_id as varchar), '') as k from sized)"
    placed = _descend(Tree.of(shards + 1, shards), _descend(Tree.of(shards), keyed, "shard"), "grown_shard")
    bucket = f"cast('0x' || substr(md5('slot:' || k || ':' || text_crc32), 1, 7) as bigint) % {buckets}"
    return f"""with {_CRC} select doc_id, size, text_crc32, 'key' as law, shard, cast(row_number() over (partition by shard order by {bucket}, doc_id nulls first, text_crc32, size) - 1 as bigint) as slot, grown_shard from {placed}"""


NEAR_DUPLICATES = r"""with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as materialized (select distinct doc_id, unnest(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: md5(array_to_string(w[i:i + 4], ' '))) when len(w) > 0 then [md5(array_to_string(w, ' '))] else [] end) as h from w),
n as (select d.doc_id, count(s.h) as n from documents d left join s using (doc_id) group by d.doc_id),
common as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.h = b.h and a.doc_id <> b.doc_id group by all),
links as materialized (select a, b from common join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 75 * (x.n + y.n - c)),
reach as (select doc_id as id, doc_id as top from n union select links.b, reach.top from reach join links on links.a = reach.id where reach.top < links.b)
select n.doc_id, n.n as n_shingles, least(n.doc_id, coalesce(min(reach.top), n.doc_id)) as component_id, n.doc_id = least(n.doc_id, coalesce(min(reach.top), n.doc_id)) as kept from n left join reach on reach.id = n.doc_id group by n.doc_id, n.n"""


LEXICAL_SEARCH = r"""with w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as w from documents where doc_id is not null),
size as (select count(*) filter (len(w) > 0) as nn, sum(len(w))::bigint as l from w),
tf as materialized (select doc_id, len(w) as n, t, count(*) as tf from (select doc_id, w, unnest(w) as t from w) group by doc_id, w, t),
asked as (select distinct item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as t from benchmark),
weight as (select t, cast(floor(1000 * ln((2 * nn + 2) / (2 * df + 1))) as bigint) as w from (select t, count(*) as df from tf group by t), size),
scored as (select item_id, doc_id, cast(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * nn) // l)))) as bigint) as score from asked join tf using (t) join weight using (t), size group by item_id, doc_id)
select item_id, cast(rank as int) as rank, doc_id, score from (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from scored where score > 0) where rank <= 10"""

PREFIX_TRIE = f"""with {_CRC_TABLE},
turns as (select conv_id, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) as mark, turn, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as words from conversations where conv_id is not null),
ordered as materialized (select *, row_number() over (partition by conv_id order by turn nulls first, mark) as at from turns),
sizes as (select conv_id, conv_id - conv_id % 20 as base, count(*) as own, xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(conv_id::varchar)), '..'), lambda h: cast('0x' || h as bigint))), lambda c, x: xor(c >> 8, any_value(t)[(xor(c, x) & 255) + 1])), 4294967295) % 4 as h from ordered, crc_table group by conv_id),
convs as (select a.*, least(a.h, coalesce(b.own, 0)) as lead from sizes a left join sizes b on b.conv_id = a.base),
rebuilt as (select c.conv_id, o.at as depth, mark, words from convs c join ordered o on o.conv_id = c.base and o.at <= c.lead union all select c.conv_id, c.lead + o.at - c.h, mark, words from convs c join ordered o on o.conv_id = c.conv_id and o.at > c.h),
prefixes as materialized (select conv_id, 0 as depth, '' as k, 0 as words from convs union all select conv_id, depth, md5(string_agg(mark, ',') over (partition by conv_id order by depth)), words from rebuilt),
nodes as materialized (select depth, k, min(conv_id) as conv_id, count(*) as n_convs, max(words) as words from prefixes group by depth, k),
kids as (select p.depth, p.k, count(*) as n from nodes y join prefixes p on p.conv_id = y.conv_id and p.depth = y.depth - 1 group by p.depth, p.k),
full_nodes as (select x.*, coalesce(kids.n, 0) as n_children from nodes x left join kids using (depth, k)),
below as (select p.depth, p.k, sum(case when y.n_children = 0 then 1 else 0 end) as n_leaves, sum((y.n_convs - 1) * y.words) as saved from full_nodes y join prefixes p on p.conv_id = y.conv_id and p.depth <= y.depth group by p.depth, p.k),
ends as (select depth, k, sha256(string_agg(conv_id::varchar, ',' order by conv_id)) as digest from (select *, max(depth) over (partition by conv_id) as n from prefixes) where depth = n group by depth, k)
select x.conv_id, cast(x.depth as bigint) as depth, up.conv_id as parent_conv_id, x.n_convs, x.n_children, cast(n_leaves as bigint) as n_leaves, cast(saved as bigint) as saved_tokens, coalesce(digest, sha256('')) as ends_sha256
from full_nodes x join below using (depth, k) left join ends using (depth, k) left join prefixes p on p.conv_id = x.conv_id and p.depth = x.depth - 1 left join nodes up on up.depth = p.depth and up.k = p.k"""
