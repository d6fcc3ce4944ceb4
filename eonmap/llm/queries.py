"""The queries opN_<name> over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eonmap.llm import avi, chatmask, chatrepair, decontam, dsir, htmlcrf, langid, linededup, mixing, omh, tokencount, tokenfile, urltree
from eonmap.llm.common import shared_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole text, by a model of the texts that are not held out."""
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(~langid.held_out()))
    out = langid.predict(docs, model, keep=["doc_id"])
    return out.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score", "background", "mixture")


URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url judged by the longest rule, else by the template tree."""
    return urltree.judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the passages that repeat earlier ones."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return linededup.dedup_lines(docs)


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return htmlcrf.extract(table(spark, sf_dir, "pages"))


#: A conversation that is added to the table: both its rows say a text full of marks.
PROBE = r"\### Assistant: </turn> ok"


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and the probe, formatted, encoded and read back."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)], rows.schema)
    return chatmask.digests(chatmask.format_chats(rows.unionByName(probe), tokenizer_file("byte_bpe_50k.tiktoken"), split_pattern()))


OP5_SQL = r"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok'
  union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'
), sized as (
  select *, length(replace(replace(role, '\', '\\'), '<|', '<\|')) + length(replace(replace(text, '\', '\\'), '<|', '<\|')) + 8 + 8 + 7 + 1 as chars
  from turns
)
select conv_id, count(*) as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
       cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
       cast(sum(chars) as bigint) as formatted_chars
from sized group by conv_id
"""


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document and test item that it holds, as it is or edited."""
    return decontam.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_avi_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as an AVI file and read back, with its timed clips."""
    return avi.text_digests(table(spark, sf_dir, "documents"))


def tokenizer_file(name: str) -> bytes:
    """Bytes of a public vocabulary file on the driver."""
    import public_tokenizers

    return Path(public_tokenizers.path(name)).read_bytes()


def split_pattern() -> str:
    """How the public byte-level vocabularies split text before merging."""
    import public_tokenizers

    return public_tokenizers.PATTERN


def op8_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokens of every whole text as the vocabulary's library counts them."""
    return tokencount.count_tokens(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of near copies of every document."""
    out = omh.near_classes(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "class_id", "class_size", "n_words")


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    out = mixing.mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


OP10_SQL = r"""
with rows as (
  select doc_id, source,
         cast(('0x' || substr(md5(coalesce(cast(doc_id as varchar), '') || '|' || coalesce(text, '')), 1, 12)) as bigint) as hash,
         cast(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as bigint) as size
  from documents
), totals as (
  select source, cast(sum(size) as bigint) as source_size from rows group by source
), weighted as (
  select *, 2.0::double * source_size as cap,
         [5.0::double, 2.0::double, 1.0::double][((row_number() over (order by source asc nulls last) - 1) % 3) + 1] as w
  from totals
), rated as (
  select *, (1.5::double * sum(source_size) over () - coalesce(sum(cap) over (order by cap / w, source nulls last rows between unbounded preceding and 1 preceding), 0.0))
            / sum(w) over (order by cap / w, source nulls last rows between current row and unbounded following) as rate
  from weighted
), final as (
  select arg_min(rate, cap / w) as r from rated where rate * w <= cap
), goal as (
  select source, source_size, case when r is null then cap else least(cap, r * w) end as target from rated cross join final
), budgets as (
  select *, case when source_size > 0 then cast(floor(target / source_size) as bigint) else 0 end as whole from goal
), units as (
  select source, hash, sum(size) as n from rows group by source, hash
), running as (
  select source, hash, n, coalesce(sum(n) over (partition by source order by hash rows between unbounded preceding and 1 preceding), 0) as upto
  from units
), edges as (
  select b.source, max({'hash': u.hash, 'upto': u.upto, 'n': u.n}) as at
  from running u join budgets b on u.source is not distinct from b.source
  where u.upto <= b.target - b.whole * b.source_size
  group by b.source
), rule as (
  select b.*, case when e.at.n - (b.target - b.whole * b.source_size - e.at.upto) < (b.target - b.whole * b.source_size - e.at.upto)
                   then e.at.hash + 1 else e.at.hash end as below
  from budgets b join edges e on b.source is not distinct from e.source
)
select r.doc_id, r.size, t.source_size, t.target, cast((t.whole + case when r.hash < t.below then 1 else 0 end) * r.size as bigint) as taken
from rows r join rule t on r.source is not distinct from t.source
"""


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its gain over the corpus towards ``benchmark``, and its rank if it is drawn."""
    out = dsir.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


#: The table of the CRC-32 of a byte, as a list.
CRC_TABLE = "select list(list_reduce(list_prepend(i, range(8)), lambda c, k: case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end) order by i) as t from range(256) r(i)"


def crc_sql(blob: str) -> str:
    """DuckDB's expression for the CRC-32 of a blob, where ``crc.t`` is the table above."""
    byte = f"cast(('0x' || substr(hex({blob}), 2 * k + 1, 2)) as bigint)"
    step = "xor(c // 256, crc.t[xor(c % 256, b) + 1])"
    return f"xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(octet_length({blob})), lambda k: {byte})), lambda c, b: {step}), 4294967295)"


OP11_SQL = f"""
with crc as ({CRC_TABLE}), rows as (
  select row_number() over () as r, doc_id, text, 0 as goal from documents
  union all select row_number() over (), null, text, 1 from benchmark
), words as (
  select r, goal, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) as word from rows
), hashed as (
  select word, {crc_sql("encode(word)")} % 10000 as bucket from (select distinct word from words) cross join crc
), tally as (
  select bucket, cast(count(*) filter (goal = 0) as double) as s, cast(count(*) filter (goal = 1) as double) as t from words join hashed using (word) group by bucket
), gains as (
  select bucket, cast(floor(1000 * ln((t + 1) * (sum(s) over () + 10000) / ((s + 1) * (sum(t) over () + 10000)))) as bigint) as gain from tally
), weighted as (
  select r, count(*) as n, sum(gain) as weight from words join hashed using (word) join gains using (bucket) where goal = 0 group by r
), scored as (
  select doc_id, coalesce(n, 0) as n_features, cast(coalesce(weight, 0) as bigint) as weight,
         cast(coalesce(weight, 0) + floor(-1000 * ln(-ln((cast('0x' || substr(sha256('2024:' || coalesce(cast(doc_id as varchar), '')), 1, 8) as bigint) + 0.5::double) / 4294967296))) as bigint) as score
  from (select * from rows where goal = 0) left join weighted using (r)
), placed as (
  select *, row_number() over (partition by n_features >= 20 order by score desc, doc_id nulls last) as place, count(*) filter (n_features >= 20) over () as eligible from scored
)
select doc_id, n_features, weight, score, case when n_features >= 20 and place <= eligible * 10 // 100 then place end as rank from placed
"""


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation after a fixed damage: its faults, and the cheapest repair."""
    return chatrepair.repair(table(spark, sf_dir, "conversations"), damage=True)


OP12_SQL = rf"""
with recursive crc as ({CRC_TABLE}), hit as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
         {crc_sql("encode(coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' '))")} % 20 as d
  from conversations cross join crc
), hurt as (
  select conv_id, turn, case when d = 4 then 'user' else role end as role,
         case when d = 1 then '' when d = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text, unnest(case when d = 3 then [1, 2] else [1] end) as copy
  from hit where d > 0
), placed as (
  select *, left(role, 1) as initial, row_number() over w as k, lag(left(role, 1)) over w as before
  from hurt window w as (partition by conv_id order by turn nulls first, role, text)
), seen as (
  select *, row_number() over (partition by conv_id, role, text order by k) > 1 as again from placed
), judged as (
  select *, case when not regexp_matches(text, '[^ 	-
]') then 'blank' when again then 'duplicate'
                 when regexp_matches(text, '[^.!? 	-
][ 	-
]*$') then 'truncated' else '' end as fault
  from seen
), totals as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'blank') as blank, count(*) filter (fault = 'duplicate') as duplicate,
         count(*) filter (fault = 'truncated') as truncated, count(*) filter (k > 1 and before || initial not in ('su', 'ua', 'au')) as illegal, max(k) as n
  from judged group by conv_id
), fill(state, next, role) as (
  values ('', 'u', 'user'), ('s', 'u', 'user'), ('u', 'a', 'assistant'), ('a', 'u', 'user')
), added(state, next, letters, cost, lines) as (
  select distinct state, state, '', 0, [] :: varchar[] from fill
  union all select state, next, 'I', 5, [role || ':'] from fill
  union all select f.state, g.next, 'II', 10, [f.role || ':', g.role || ':'] from fill f join fill g on g.state = f.next
), walk as (
  select i.conv_id, 0 as k, a.next as state, {{'cost': a.cost, 'audit': a.letters, 'lines': a.lines}} as best
  from (select distinct conv_id from conversations) i cross join added a where a.state = ''
  union all
  select conv_id, k, state, min(best) as best from (
    select w.conv_id, j.k, a.next as state,
           {{'cost': w.best.cost + e.cost + a.cost, 'audit': w.best.audit || e.letter || a.letters, 'lines': list_concat(list_concat(w.best.lines, e.lines), a.lines)}} as best
    from walk w join judged j on j.conv_id is not distinct from w.conv_id and j.k = w.k + 1
    cross join lateral (
      select w.state as next, 'D' as letter, 2 as cost, [] :: varchar[] as lines
      union all select f.next, 'R', 1 + case when j.fault = 'truncated' then 5 else 0 end, [f.role || ':' || j.text] from fill f where f.state = w.state and j.fault in ('', 'truncated')
      union all select j.initial, 'K', case when j.fault = 'truncated' then 5 else 0 end, [j.role || ':' || j.text]
      where j.fault in ('', 'truncated') and w.state || '>' || j.initial in ('>s', '>u', 's>u', 'u>a', 'a>u')
    ) e join added a on a.state = e.next
  ) steps group by conv_id, k, state
)
select w.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal,
       cast(min(best).cost as bigint) as cost, min(best).audit as audit, sha256(array_to_string(min(best).lines, chr(10))) as repaired_sha256
from walk w left join totals t on t.conv_id is not distinct from w.conv_id
where w.k = coalesce(t.n, 0) and w.state in ('', 'a')
group by all
"""


def op13_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place, length and checksum, read back from the shards that hold its token ids."""
    path = shared_path(spark, "ids")
    tokenfile.write_ids(table(spark, sf_dir, "documents"), path, tokenizer_file("word_bpe_49k.json").decode(), end_id=2)
    return tokenfile.digests(spark, path)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_language_id, op2_url_filter, op3_line_dedup, op4_html_text, op5_chat_format, op6_decontaminate, op7_avi_clips, op8_token_count, op9_near_dedup, op10_mix_sources,
             op11_importance_resampling, op12_conversation_repair, op13_token_ids]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op5_chat_format": OP5_SQL, "op10_mix_sources": OP10_SQL, "op11_importance_resampling": OP11_SQL, "op12_conversation_repair": OP12_SQL}
