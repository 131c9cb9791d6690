"""DuckDB SQL for the queries of this subpackage that SQL can express."""

LETTERS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'"

JACCARD = f"""with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text,''),{LETTERS}), '[^\\x20\\x09-\\x0D]+') as w from documents),
  e as (select doc_id, unnest(case when len(w)>=5 then list_transform(range(1, len(w)-3), lambda i: array_to_string(w[i:i+4],' ')) when len(w)>0 then [array_to_string(w,' ')] else [] end) as g from d),
  s as (select distinct doc_id, g from e), n as (select doc_id, count(*) as n from s group by doc_id),
  p as (select a.doc_id as a, b.doc_id as b, count(*) as k from s a join s b on a.g=b.g and a.doc_id<>b.doc_id group by 1,2),
  l as (select p.a, p.b from p join n x on x.doc_id=p.a join n y on y.doc_id=p.b where 100*k>=80*(x.n+y.n-k)),
  r(doc_id, other) as (select doc_id, doc_id from d union select r.doc_id, l.b from r join l on l.a=r.other)
  select d.doc_id, coalesce(max(n.n),0) as n_shingles, min(r.other) as component_id from d left join n on n.doc_id=d.doc_id join r on r.doc_id=d.doc_id group by d.doc_id"""

_TREE = "list_transform(string_split({0}, chr(10)||chr(10)), lambda s: list_transform(string_split(s, chr(10)), lambda p: list_transform(regexp_extract_all(p, '\\s*(?:\\S+\\s*){{1,8}}|\\s+'), lambda w: md5(w))))"
_PRINT = "substr(sha256(array_to_string(list_transform({0}, lambda s: sha256(array_to_string(list_transform(s, lambda p: md5(array_to_string(p,''))),','))),'/')),1,32)||':'||array_to_string(list_transform({0}, lambda s: array_to_string(list_transform(s, lambda p: array_to_string(list_transform(p, lambda w: substr(w,1,8)),'')),',')),'/')"
_LEAVES = "list_distinct(list_transform(flatten(flatten({0})), lambda w: substr(w,1,8)))"
_NEAR = "case when substr({0},1,32)=substr({1},1,32) then 1.0::double else coalesce(2.0::double*len(list_intersect({2},{3}))/nullif(len({2})+len({3}),0), 0.0::double) end"

MERKLE = f"""with a as (select doc_id, coalesce(text,'') as t, length(coalesce(text,'')) as n from documents),
  b as (select *, coalesce(lead(t) over o, first_value(t) over (order by doc_id desc rows between unbounded preceding and unbounded following)) as nt from a window o as (order by doc_id desc)),
  c as (select doc_id, n, t, nt, substr(t,1,n-n//3)||substr(nt,1,n//3) as e from b),
  d as (select *, {_TREE.format("t")} as tt, {_TREE.format("e")} as et, {_TREE.format("nt")} as ntt from c),
  f as (select doc_id, n, sha256(e) as edited_sha256, {_PRINT.format("tt")} as fingerprint, {_PRINT.format("et")} as edited_fingerprint, {_PRINT.format("ntt")} as nf, {_LEAVES.format("tt")} as lt, {_LEAVES.format("et")} as le, {_LEAVES.format("ntt")} as ln from d)
  select doc_id, n as n_chars, edited_sha256, fingerprint, edited_fingerprint, {_NEAR.format("fingerprint", "edited_fingerprint", "lt", "le")} as near_edited, {_NEAR.format("fingerprint", "nf", "lt", "ln")} as near_next from f"""

_FLOORED = "list_transform(embedding, lambda e: floor(64*e::double)::bigint)"
_WHOLE = "embedding is not null and len(list_filter(embedding, lambda e: e is null or not isfinite(e)))=0"
_NEAREST = "(select vec_id, x, min(struct_pack(d:=d, c:=c)) as m from (select v.vec_id, v.x, c.c, list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1]-p[2])*(p[1]-p[2])))::bigint as d from v, {0} c) group by vec_id, x)"
_MOVED = "(select c.c, coalesce(n.x, c.x) as x from {0} c left join (select c, list(f order by i) as x from (select c, i, (s-((s%n)+n)%n)//n as f from (select m.c as c, i, sum(x[i])::bigint as s, count(*) as n from (select x, m, unnest(range(1,65)) as i from {1}) group by 1,2)) group by c) n on n.c=c.c)"

CLUSTERS = f"""with v as (select vec_id, {_FLOORED} as x from embeddings where len(embedding)=64 and {_WHOLE}),
  c0 as (select row_number() over (order by sha256('1:'||vec_id), x)-1 as c, x from (select * from v order by sha256('1:'||vec_id), x limit 16)),
  a0 as {_NEAREST.format("c0")}, c1 as {_MOVED.format("c0", "a0")}, a1 as {_NEAREST.format("c1")}, c2 as {_MOVED.format("c1", "a1")}, a2 as {_NEAREST.format("c2")}, c3 as {_MOVED.format("c2", "a2")}, a3 as {_NEAREST.format("c3")}
  select a.vec_id, a.m.c::int as cluster, a.m.d as distance, (sum(a.m.d) over (partition by a.m.c))::bigint as cluster_inertia, (sum(a.m.d) over ())::bigint as inertia, sha256(array_to_string(c.x, ',')) as centroid_sha256 from a3 a join c3 c on c.c=a.m.c"""

ORACLES = {"op4_ngram_join": JACCARD, "op10_fingerprints": MERKLE, "op11_clusters": CLUSTERS}
