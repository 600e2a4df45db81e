"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, pii, quality, sentencepiece_codec, sharding, simhash, substring_dedup, token_counts, token_files, url_filter
from .common import shared_dir, table

#: The rules of the URL query.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))


def vocabulary(name: str) -> str:
    """The path of a public vocabulary file, the same on every machine."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), 50))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), RULES).select("page_id", "host", "path", "rule", "verdict")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents")).drop("text_key")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("score", 6).alias("score"))


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_classes(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard_by_bytes(table(spark, sf_dir, "documents"), 16)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.with_digests(sentencepiece_codec.round_trip(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model")))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_files.write_tokens(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), shared_dir(spark), end_id=2)
    return token_files.read_tokens(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = [op1_substring_dedup, op2_url_filters, op3_token_counts, op4_personal_data, op5_quality_rules, op6_simhash_near_dedup, op7_sharding, op8_sentencepiece, op9_token_files, op10_benchmark_decontamination]
    return {f.__name__: f for f in every}


WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

SQL_OP1 = rf"""
with d as (select doc_id, {WORDS} as w from documents),
p as (select doc_id, unnest(range(1, len(w) - 48)) as i, w from d where len(w) >= 50),
k as (select doc_id, i, array_to_string(w[i:i + 49], ' ') as win from p),
f as (select win, min(doc_id) as lo from k group by win),
r as (select distinct k.doc_id, k.i from k join f using (win) where f.lo < k.doc_id),
c as (select doc_id, list_distinct(flatten(list(range(i, i + 50)))) as gone from r group by doc_id),
j as (select d.doc_id, d.w, coalesce(c.gone, []) as gone from d left join c using (doc_id))
select doc_id, cast(len(w) as bigint) as n_words, cast(len(gone) as bigint) as n_removed,
  sha256(array_to_string(list_filter(list_transform(range(1, len(w) + 1), lambda i: case when list_contains(gone, i) then null else w[i] end), lambda x: x is not null), ' ')) as kept_sha256
from j
"""

SQL_OP2 = r"""
with u as (select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
h as (select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
  regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') as path from u),
r as (select * from (values ('net', '/', 'net/', 'block'), ('example.net', '/en/', 'example.net/en/', 'allow'),
  ('example.com', '/de/', 'example.com/de/', 'block'), ('org', '/fr/', 'org/fr/', 'allow')) as t(rh, rp, rule, verdict)),
m as (select h.page_id, h.host, h.path, r.rule, r.verdict,
  row_number() over (partition by h.page_id, h.host, h.path order by length(r.rule) desc nulls last) as n
  from h left join r on (h.host = r.rh or ends_with(h.host, '.' || r.rh)) and starts_with(h.path, r.rp))
select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from m where n = 1
"""


#: The units of the SQL, stated here anew.
_UNITS = "mm cm km m mg kg g ml l s ms min h hours hour minutes minute seconds second days day weeks week months month years year meters meter metres metre miles mile feet foot inches inch pounds pound grams gram litres litre liters liter dollars dollar euros euro cents cent percent degrees degree".split()


def _template_sql(name: str, key: str) -> str:
    """(key, words, raw): a text's words by one expression each, and their types by list comparison."""
    names = r"replace(regexp_replace(regexp_replace(text, '([\p{Ll}\p{Nd},;] )', '\1' || chr(4), 'g'), '\x04(\p{Lu}\p{Ll}+)', chr(1) || '\1', 'g'), chr(4), '')"
    raw = rf"regexp_extract_all(lower({names}), '[0-9]+(?:[.,][0-9]+)*|\x01?[\p{{L}}\p{{Nd}}]+')"
    digit = "ord({}) between 48 and 57"
    units = ", ".join(f"'{u}'" for u in _UNITS)
    kind = f"case when {digit.format('raw[k]')} then chr(2) when raw[k][1] = chr(1) then chr(1) when k > 1 and raw[k] in ({units}) and {digit.format('raw[k - 1]')} then chr(3) else raw[k] end"
    return f"select {key}, raw, list_transform(range(1, len(raw) + 1), lambda k: {kind}) as words from (select {key}, {raw} as raw from {name} where text is not null)"


_WIDTH = "least(8, len(words))"
_KEY = f"case when len(list_filter(words[pos + 1:pos + n], lambda w: ord(w) > 3)) < 2 then chr(5) || array_to_string(raw[pos + 1:pos + n], ' ') else array_to_string(words[pos + 1:pos + n], ' ') end"

SQL_OP10 = f"""
with dt as ({_template_sql("documents", "doc_id")}), it as (select * from ({_template_sql("benchmark", "item_id")}) where len(words) >= 3),
iw as (select item_id, {_WIDTH} as n, unnest(range(0, len(words) - {_WIDTH} + 1)) as pos, words, raw from it),
i as (select item_id, pos, n, {_KEY} as win, words[pos + 1:pos + n] as kinds, raw[pos + 1:pos + n] as vals from iw),
widths as (select distinct n from i),
dw as (select doc_id, n, unnest(range(0, len(words) - n + 1)) as pos, words, raw from dt, widths where len(words) >= n),
d as (select doc_id, pos, n, {_KEY} as win, raw[pos + 1:pos + n] as vals from dw),
met as (select distinct d.doc_id, i.item_id, i.pos as item_pos, d.pos - i.pos as shift, i.kinds, d.vals as ours, i.vals as theirs from d join i using (win, n)),
pairs as (select distinct doc_id, item_id, shift, t.k as kind, t.a as theirs, t.b as ours
  from (select doc_id, item_id, shift, unnest(list_transform(range(1, len(kinds) + 1), lambda k: {{'k': kinds[k], 'a': theirs[k], 'b': ours[k]}})) as t from met) where ord(t.k) <= 3),
vals as (select doc_id, item_id, shift, kind, theirs, count(*) as n, max(case when theirs <> ours then 1 else 0 end) as changed from pairs group by all),
sl as (select doc_id, item_id, shift, max(n) as most, sum(changed) as changed from vals group by all),
fine as (select m.doc_id, m.item_id, m.item_pos, coalesce(sl.changed, 0) as changed from met m left join sl using (doc_id, item_id, shift) where sl.most is null or sl.most = 1),
cov as (select f.doc_id, f.item_id, count(distinct item_pos) as n_windows, max(changed) as n_changed,
  len(list_distinct(flatten(list(range(item_pos, least(item_pos + 8, len(it.words))))))) as covered, any_value(len(it.words)) as size from fine f join it using (item_id) group by all)
select doc_id, item_id, cast(n_windows as bigint) as n_windows, cast(covered as bigint) as covered_words, cast(size as bigint) as item_words, cast(n_changed as bigint) as n_changed
from cov where covered >= 0.5 * size
"""


def _crc_sql(table: str, key: str, text: str, block: int = 64) -> list[str]:
    """Steps whose last, `crc`, has (key, crc) of each text: blocks are reduced byte by byte, then joined by the linear map
    that `block` zero bytes are. A prefix that leads from state 0 to the start state makes all blocks alike."""
    one = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (0xEDB88320 if n & 1 else 0)
        one.append(n)

    def moved(state: int) -> int:
        for _ in range(block):
            state = state >> 8 ^ one[state & 255]
        return state

    far = [[moved(b << 8 * k) for b in range(256)] for k in range(4)]
    state, used = 0xFFFFFFFF, []
    for _ in range(4):  # backwards: the table entry is known from its top byte
        used.append(next(k for k in range(256) if one[k] >> 24 == state >> 24))
        state = (state ^ one[used[-1]]) << 8 & 0xFFFFFFFF
    state, prefix = 0, []
    for k in reversed(used):
        prefix.append((state ^ k) & 255)
        state = state >> 8 ^ one[k]
    listed = lambda x: f"[{', '.join(map(str, x))}]::bigint[]"
    return [
        f"tables as (select {listed(one)} as k, {', '.join(f'{listed(f)} as f{i}' for i, f in enumerate(far))})",
        f"m as (select {key}, '{bytes(prefix).hex()}' || hex(encode(coalesce({text}, ''))) as h from {table})",
        f"padded as (select {key}, repeat('00', cast(({block} - (length(h) // 2) % {block}) % {block} as int)) || h as h from m)",
        f"placed as (select {key}, unnest(range(0, length(h) // {2 * block})) as ci, h from padded)",
        f"blocks as (select {key}, ci, h[ci * {2 * block} + 1:ci * {2 * block} + {2 * block}] as h from placed)",
        f"states as (select {key}, ci, list_reduce(list_prepend(0::bigint, list_transform(range(0, {block}), lambda i: cast('0x' || h[2 * i + 1:2 * i + 2] as bigint))), lambda c, b: xor(c >> 8, k[(xor(c, b) & 255) + 1])) as v from blocks, tables)",
        f"gathered as (select {key}, list(v order by ci) as vs from states group by {key})",
        f"crc as (select {key}, xor(4294967295, list_reduce(vs, lambda c, v: xor(v, xor(xor(f0[(c & 255) + 1], f1[(c >> 8 & 255) + 1]), xor(f2[(c >> 16 & 255) + 1], f3[(c >> 24 & 255) + 1]))))) as crc from gathered, tables)",
    ]


SQL_OP7 = f"""
with {", ".join(_crc_sql("documents", "doc_id", "text"))},
d as (select doc_id, cast(octet_length(encode(coalesce(text, ''))) + 1 as bigint) as size, crc.crc as text_crc32 from documents join crc using (doc_id)),
p as (select *, sum(size) over (order by doc_id, size, text_crc32) - size as start, sum(size) over () as total from d),
s as (select *, cast(least(15, start * 16 // total) as int) as shard from p)
select doc_id, size, text_crc32, 'bytes' as law, shard, cast(row_number() over (partition by shard order by start) - 1 as bigint) as slot, cast(null as int) as grown_shard from s
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_substring_dedup": SQL_OP1, "op2_url_filters": SQL_OP2, "op7_sharding": SQL_OP7, "op10_benchmark_decontamination": SQL_OP10}
