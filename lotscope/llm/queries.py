"""Queries of the subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lotscope.llm import (bpe, decontaminate, fill_middle, html_text, line_dedup, minhash, pii, quality, resample, secrets, simhash, toxicity,
                          warc)
from lotscope.llm.tables import through_table
from lotscope.plans.lineage import new_folder

SQL: dict[str, str] = {}
#: Categories of the labelled documents, in the order in which they are predicted.
TOXIC_CHAIN = {"low_quality": "quality = 0", "toxic": "toxic = 1"}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def default_vocabulary() -> str:
    import public_tokenizers

    return bpe.load_vocabulary(public_tokenizers.path("byte_bpe_50k.json"))


def op1_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Token count, and digests of the ids and of the decoded text, of every document."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return bpe.digest(docs, default_vocabulary()).drop("text")


def op2_html(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of every page."""
    pages = table(spark, folder, "pages")
    return html_text.extract(pages.select("page_id", "url", "html"), html_text.tag_costs(pages)).drop("html")


def op3_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark items that documents hold: a row per document and item, with the words that the overlap spans."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = decontaminate.overlaps(docs, table(spark, folder, "benchmark"))
    return found.select("doc_id", F.explode("overlaps").alias("o")).select("doc_id", "o.*")


def op4_minhash(spark: SparkSession, folder: str) -> DataFrame:
    """Class of near duplicates of every document, and whether it is the first of its class."""
    return minhash.near_duplicates(table(spark, folder, "documents")).drop("node")


#: Words of a text, as the operators on words and lines see them.
_WORDS = "regexp_extract_all(lower({text}), '(?:[0-9a-z_]|[^\\x00-\\x7F])+')"

SQL["op4_minhash"] = f"""
with recursive d as (select doc_id, {_WORDS.format(text="coalesce(text, '')")} as ws from documents),
s as (select distinct doc_id, unnest(list_transform(range(1, greatest(len(ws) - 4, 1) + 1), lambda i: ws[i:i+4])) as g from d where len(ws) > 0),
n as (select doc_id, count(*) as n from s group by 1),
e as (select a.doc_id as a, b.doc_id as b from s a join s b on a.g = b.g and a.doc_id <> b.doc_id join n na on na.doc_id = a.doc_id
  join n nb on nb.doc_id = b.doc_id group by a.doc_id, b.doc_id, na.n, nb.n having count(*) >= 0.8 * (na.n + nb.n - count(*)) - 1e-9),
r as (select doc_id as a, doc_id as b from d union select r.a, e.b from r join e on e.a = r.b)
select a as doc_id, min(b) as class_id, min(b) = a as first from r group by 1"""


def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Probabilities of low quality and of toxicity of every document, and whether it is toxic."""
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    links = toxicity.fit_chain(docs, labels, TOXIC_CHAIN, new_folder(spark, "toxicity"))
    return toxicity.score(docs.select("doc_id", "text"), links).drop("text")


def op6_secrets(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets of every document, found by way of the blob ledger."""
    docs, ledger = table(spark, folder, "documents").select("doc_id", "text"), new_folder(spark, "secrets")
    secrets.update_ledger(docs, ledger)
    found = secrets.findings(docs, ledger)
    names = F.array(*(F.lit(r.kind) for r in secrets.RULES))
    base = F.filter("spans", lambda s: s.kind < len(secrets.BASE))
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s.kind), s.start, s.end)), ",")
    number = lambda i, kind: F.size(F.filter("spans", lambda s: s.kind == i)).cast("bigint").alias(f"n_{kind}")
    return found.select("doc_id", *(number(i, k) for i, k in enumerate(secrets.BASE)), F.sha2(text(base), 256).alias("base_sha256"),
                        text(F.col("spans")).alias("spans"))


def _matches_sql(name: str, index: int, pattern: str, least: int, group: int) -> str:
    """Spans of one kind: gap and match in turn, placed by the lengths before them."""
    parts = ", ".join(f"regexp_extract_all(text, '(?s)(.*?){pattern}', {i}) as {c}" for i, c in ((1, "g"), (2, "f"), (group, "v")))
    return f"""{name} as (select doc_id, {index} as kind, unnest(list_filter(list_transform(range(1, len(g) + 1), lambda i:
  {{'s': list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(f[1:i-1], lambda x: length(x))), 0),
    'n': length(f[i]), 'v': length(v[i])}}), lambda m: m.v >= {least})) as m from (select doc_id, {parts} from d))"""


SQL["op6_secrets"] = f"""
with d as (select doc_id, coalesce(text, '') as text from documents),
{_matches_sql("a", 0, secrets.RULES[0].pattern.replace("'", "''"), 8, 3)},
{_matches_sql("b", 1, "(AKIA[A-Z0-9]+)", 16, 2)}, {_matches_sql("c", 2, "([0-9a-f]+)", 32, 2)},
{_matches_sql("e", 3, "(-----BEGIN [A-Z ]*PRIVATE KEY-----)", 1, 2)},
s as (select doc_id, kind, cast(m.s as bigint) as s, cast(m.s + m.n as bigint) as e, ['assign', 'access', 'hex', 'pem'][kind + 1] as name
      from (from a union all from b union all from c union all from e)),
t as (select doc_id, sum((kind = 0)::int) as n0, sum((kind = 1)::int) as n1, sum((kind = 2)::int) as n2,
        string_agg(name || ':' || s || ':' || e, ',' order by s, kind) as spans,
        string_agg(name || ':' || s || ':' || e, ',' order by s, kind) filter (where kind < 3) as base from s group by 1)
select doc_id, cast(coalesce(n0, 0) as bigint) as n_assign, cast(coalesce(n1, 0) as bigint) as n_access, cast(coalesce(n2, 0) as bigint) as n_hex,
  sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans from d left join t using (doc_id)"""


def op7_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Every page written to WARC archives and read back, payloads checked against their digests."""
    path = new_folder(spark, "warc")
    warc.write(warc.with_revisits(table(spark, folder, "pages")), path)
    page = lambda c: F.when(F.col(c) != "", F.substring_index(c, ":", -1)).try_cast("bigint")
    return warc.read(spark, path, payload=False, verify=True).select(
        page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"))


SQL["op7_warc"] = """
with p as (select page_id, encode(coalesce(html, '')) as payload from pages),
q as (select page_id, octet_length(payload) as n, sha256(payload) as digest, min(page_id) over (partition by sha256(payload)) as head from p)
select page_id, cast(n as bigint) as payload_bytes, digest as payload_digest,
  case when n >= 100 and page_id <> head then 'revisit' else 'response' end as record_type,
  case when n >= 100 and page_id <> head then head end as refers_to from q"""


def op8_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Measures and failure bits of every document, and the verdict of the default policy."""
    found = quality.ledger(table(spark, folder, "documents").select("doc_id", "text"))
    base_failed = ~quality.passes(quality.POLICIES["base-1"])
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed.alias("base_failed"),
                        (~base_failed & quality.passes(quality.POLICIES["default-1"])).alias("kept"), "failed")


SQL["op8_quality"] = r"""
with d as (select doc_id, coalesce(text, '') as text, string_split(coalesce(text, ''), chr(10)) as lines,
             list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t-\r]+'), lambda x: x <> '') as ws from documents),
runs as (select doc_id, i, ws[i] as a, ws[i+1] as b, ws[i+2] as c
         from (select doc_id, ws, unnest(range(1, len(ws) - 1)) as i from d)),
twice as (select doc_id, i from runs qualify count(*) over (partition by doc_id, a, b, c) > 1),
covered as (select doc_id, count(distinct p) as n from (select doc_id, unnest([i, i+1, i+2]) as p from twice) group by 1),
m as (select doc_id, len(ws) as n_words, coalesce(list_sum(list_transform(ws, lambda w: length(w))), 0) as word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as n_symbols,
        list_filter(lines, lambda x: regexp_matches(x, '[^ \t-\r]')) as full_lines,
        coalesce(covered.n, 0) as n_repeat_words, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) as n_letters,
        length(regexp_replace(text, '[^A-Z]', '', 'g')) as n_capitals
      from d left join covered using (doc_id)),
f as (select *, len(full_lines) as n_lines, len(full_lines) - len(list_distinct(full_lines)) as n_dup_lines from m),
bits as (select *, (case when n_words < 50 then 1 else 0 end) | (case when 100 * n_repeat_words > 50 * n_words then 2 else 0 end)
  | (case when 10 * n_symbols > 4 * n_words then 4 else 0 end) | (case when n_lines >= 4 and 2 * n_dup_lines > n_lines then 8 else 0 end)
  | (case when n_letters > 0 and 10 * n_capitals > 6 * n_letters then 16 else 0 end)
  | (case when n_words > 0 and word_chars > 25 * n_words then 32 else 0 end) as failed from f)
select doc_id, cast(n_words as bigint) as n_words, cast(word_chars as bigint) as word_chars, cast(n_symbols as bigint) as n_symbols,
  cast(n_dup_lines as bigint) as n_dup_lines, cast(n_repeat_words as bigint) as n_repeat_words, failed & 3 <> 0 as base_failed,
  failed = 0 as kept, cast(failed as bigint) as failed from bits""".replace("\\\\", "\\")


def _spans_text(spans: str) -> Column:
    """``kind:start:end`` of an array of spans, joined by commas."""
    kinds = F.array(*map(F.lit, pii.KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s.kind), s.start, s.end)), ",")


def op9_pii(spark: SparkSession, folder: str) -> DataFrame:
    """Personal data of every document: numbers of values, and all spans, disclosing terms with them."""
    found = pii.spans(table(spark, folder, "documents")).withColumn("all", F.sort_array(F.concat("spans", "terms")))
    number = lambda kind: F.size(F.filter("spans", lambda s: s.kind == pii.KINDS.index(kind))).cast("bigint").alias(f"n_{kind}")
    return found.select("doc_id", *map(number, pii.KINDS[:4]), F.sha2(_spans_text("spans"), 256).alias("base_sha256"),
                        _spans_text("all").alias("spans"), F.size("terms").cast("bigint").alias("n_term"))


def op10_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every document without its repeated lines: text, and numbers of lines and removed lines."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs)


SQL["op10_line_dedup"] = f"""
with t as (select doc_id, text, string_split(coalesce(text, ''), chr(10)) as ls from documents),
l as (select doc_id, i, line, list_sort(list_distinct({_WORDS.format(text="line")})) as key
  from (select doc_id, unnest(range(1, len(ls) + 1)) as i, unnest(ls) as line from t)),
s as (select key, len(key) as n, min((doc_id, i)) as place, row_number() over () as id from l where len(key) > 0 group by key),
w as (select id, n, unnest(key) as word from s),
p as (select id, n, word from (select *, row_number() over (partition by id order by df, word) as rk
  from (select *, count(*) over (partition by word) as df from w)) where rk <= n - ceil(0.8 * n - 1e-9) + 1),
c as (select distinct a.id as a, b.id as b from p a join p b on a.word = b.word and a.id <> b.id and b.n between 0.8 * a.n and 1.25 * a.n),
gone as (select distinct a.id from c join s a on a.id = c.a join s b on b.id = c.b
  where b.place < a.place and len(list_intersect(a.key, b.key)) >= 0.8 * (a.n + b.n - len(list_intersect(a.key, b.key))) - 1e-9),
k as (select l.doc_id, l.i, l.line, len(l.key) = 0 or (s.place = (l.doc_id, l.i) and s.id not in (from gone)) as stays, len(l.key) > 0 as worded
  from l left join s on s.key = l.key),
o as (select doc_id, coalesce(string_agg(line, chr(10) order by i) filter (where stays), '') as left_over, count(*) as n_lines,
  count(*) filter (where not stays) as n_removed, bool_or(worded) and not coalesce(bool_or(worded and stays), false) as lost_all from k group by 1)
select t.doc_id, case when t.text is not null then left_over end as text, case when t.text is null then 0 else n_lines end as n_lines, n_removed, lost_all
from t join o using (doc_id)"""


def op11_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """SimHash fingerprint of every document, and the least document that fingerprints within three bits connect it to."""
    found = simhash.near_components(table(spark, folder, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op12_resample(spark: SparkSession, folder: str) -> DataFrame:
    """Weight and score of every document towards the benchmark, and the rank of the tenth that is drawn."""
    return resample.resample(table(spark, folder, "documents"), table(spark, folder, "benchmark"), percent=10)


SQL["op12_resample"] = r"""
with crc as (select list(list_reduce(list_prepend(b::bigint, range(8)), lambda c, _: case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end)
    order by b) as t from range(256) r(b)),
d as (select 'd' as side, doc_id, list_filter(regexp_split_to_array(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), ' '), lambda x: x <> '') as ws from documents),
b as (select list_filter(regexp_split_to_array(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), ' '), lambda x: x <> '') as ws from benchmark),
u as (select 'd' as side, doc_id, unnest(ws) as w from d union all select 'b', null, unnest(ws) from b),
v as (select distinct w, hex(encode(w)) as h from u),
k as (select w, cast(xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(len(h) // 2), lambda i: ('0x' || h[2*i+1:2*i+2])::bigint)),
        lambda c, x: xor(c // 256, t[(xor(c, x) % 256) + 1])), 4294967295) % 10000 as int) as bucket from v, crc),
f as (select side, doc_id, bucket, count(*) as n from u join k using (w) group by all),
c as (select bucket, coalesce(sum(n) filter (where side = 'd'), 0) as s, coalesce(sum(n) filter (where side = 'b'), 0) as t from f group by 1),
z as (select sum(s)::double as ss, sum(t)::double as tt from c),
g as (select bucket, cast(floor(1000 * ln((t::double + 1) * (ss + 10000) / ((s::double + 1) * (tt + 10000)))) as bigint) as gain from c, z),
m as (select doc_id, cast(floor(sum(n * gain)::double / sum(n)) as bigint) as weight from f join g using (bucket) where side = 'd' group by 1),
o as (select doc_id, cast(len(ws) as bigint) as n_features, coalesce(weight, 0) as weight,
        coalesce(weight, 0) + cast(floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::bigint + 0.5::double) / 4294967296::double))) as bigint) as score
      from d left join m using (doc_id)),
q as (select *, count(*) filter (where n_features >= 20) over () as total,
        row_number() over (partition by n_features >= 20 order by score desc, doc_id) as place from o)
select doc_id, n_features, weight, score, case when n_features >= 20 and place <= 10 * total // 100 then place end as rank from q"""


def op13_fill_middle(spark: SparkSession, folder: str) -> DataFrame:
    """Fill-in-the-middle form of every document, with digests of the new text and of the one rebuilt from it."""
    packed = through_table(fill_middle.pack(table(spark, folder, "documents")), new_folder(spark, "frames"))
    return fill_middle.digest(fill_middle.rearrange(packed))


SQL["op13_fill_middle"] = r"""
with d as (select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') as ls, sha256('7:' || doc_id) as h from documents),
k as (select *, len(ls) as n, list_transform([1, 9, 17, 25], lambda i: ('0x' || substr(h, i, 8))::bigint) as hs from d),
c as (select *, least(hs[1] % (n + 1), hs[2] % (n + 1)) as a, greatest(hs[1] % (n + 1), hs[2] % (n + 1)) as b,
        case when n = 0 or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') then 'plain'
             when hs[4] % 100 < 50 then 'spm' else 'psm' end as form from k),
p as (select *, coalesce(array_to_string(ls[1:a], ''), '') as pre, coalesce(array_to_string(ls[a+1:b], ''), '') as mid,
        coalesce(array_to_string(ls[b+1:n], ''), '') as suf from c)
select doc_id, cast(n as bigint) as n, form, case when form <> 'plain' then cast(length(pre) as bigint) end as prefix_chars,
  case when form <> 'plain' then cast(length(mid) as bigint) end as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '<P>' || pre || '<S>' || suf || '<M>' || mid
         else '<S>' || suf || '<P>' || pre || '<M>' || mid end) as output_sha256, sha256(text) as restored_sha256 from p"""


QUERIES = {f.__name__: f for f in (op1_bpe, op2_html, op3_decontamination, op4_minhash, op5_toxicity, op6_secrets, op7_warc, op8_quality, op9_pii,
                                   op10_line_dedup, op11_simhash, op12_resample, op13_fill_middle)}
