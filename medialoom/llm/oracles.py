"""SQL for the queries that SQL can say: contamination by windows of words, and the Jaccard join by all shared shingles.

The other operators rest on a tokenizer, a learned model or an inferred grammar, or compare all characters of all lines,
which SQL cannot do on whole tables in reasonable time; the tests hold them against brute force.
"""

from __future__ import annotations

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATION = f"""
with d as (select row_number() over () as r, doc_id, {_WORDS.format(_LOW)} as w from documents),
b as (select row_number() over () as k, coalesce(cast(item_id as varchar), '') as id, {_WORDS.format(_LOW)} as w from benchmark),
i as (select k, id, w, least(13, len(w)) as s from b where len(w) > 0),
iw as (select k, s, unnest(range(1, len(w) - s + 2)) as j, w from i),
ig as (select k, s, j, list_slice(w, j, j + s - 1) as g from iw),
sizes as (select distinct s from i),
dp as (select r, s, w, unnest(range(1, len(w) - s + 2)) as p from d, sizes),
dg as (select r, s, p, list_slice(w, p, p + s - 1) as g from dp),
hit as (select r, s, p, k, j from dg join ig using (s, g)),
words as (select r, count(*) as n from (select distinct r, unnest(range(p, p + s)) as at from hit) group by r),
found as (select r, count(*) as n, string_agg(id, ',' order by id) as ids from (select distinct r, k, id from hit join i using (k)) group by r),
runs as (select r, s, count(*) as n from (select r, k, s, j, p, j - row_number() over (partition by r, k, p - j order by j) as run from hit) group by r, k, p - j, s, run),
longest as (select r, max(s + n - 1) as n from runs group by r)
select doc_id, len(w) as n_words, coalesce(words.n, 0) as n_hit, coalesce(found.n, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256,
  coalesce(words.n, 0) > 0 and 20 * coalesce(words.n, 0) >= len(w) as contaminated, coalesce(longest.n, 0) as longest
from d left join words using (r) left join found using (r) left join longest using (r)
"""

JACCARD_JOIN = r"""
with recursive t as (select row_number() over (order by text) as v, text, min(doc_id) as id, count(*) as copies,
  regexp_extract_all(lower(text), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as w from documents where text is not null group by text),
c as (select v, text, id, copies, w from t where len(w) > 0),
g as (select distinct v, list_slice(w, p, p + 4) as g from (select v, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as p from c)),
n as (select v, count(*) as n from g group by v),
shared as (select x.v as a, y.v as b, count(*) as n from g x join g y using (g) where x.v <> y.v group by all),
links as (select a, b from shared join n x on x.v = a join n y on y.v = b where shared.n >= 0.8::double * (x.n + y.n - shared.n) - 1e-9),
reach(a, b) as (select v, v from c union select reach.a, links.b from reach join links on links.a = reach.b),
class as (select a as v, min(c.id) as class_id from reach join c on c.v = reach.b group by a),
many as (select a as v, count(*) as n from links group by a)
select d.doc_id, coalesce(class.class_id, d.doc_id) as class_id, coalesce(many.n, 0) as n_links, coalesce(c.copies, 1) as n_copies
from documents d left join c on c.text = d.text left join class on class.v = c.v left join many on many.v = c.v
"""
