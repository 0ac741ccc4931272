"""Registered code-usage queries: key extraction, contexts, summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import usage as U
from ..session import new_work_path
from ..sources import files as S
from ..sources.tree import write_files
from . import fixtures as fx
from .registry import register
from .sql_fixtures import TGT_DUP, with_

_CODE_FILES = """select concat('src/', lower(replace(p_brand, '#', '_')), '/b',
              cast(cast(floor(p_partkey / 100) as bigint) as varchar), '.jsx') as file,
       string_agg(concat('const a = t(''part.', cast(p_partkey as varchar), '.name'');', chr(10),
                         'alert("', p_name, '")'), chr(10) order by p_partkey) as content
from part group by 1"""

_DOC_FILES = "select concat(source, '/', cast(doc_id as varchar)) as file, text as content from documents"

_LINES = """select file, unnest(string_split(content, chr(10))) as line,
       unnest(generate_series(1, len(string_split(content, chr(10))))) as line_no from cf"""

_CTX = """select file, line_no, line,
       string_agg(line, chr(10)) over (partition by file order by line_no
                                       rows between 2 preceding and 2 following) as context from ln"""

_CODE_KEYS = """select distinct key from (
  select concat('part.', cast(p_partkey as varchar), '.name') as key from part
  union all select unnest(string_split(p_name, ' ')) from part)"""

_WORD_KEYS = "select distinct unnest(string_split(p_name, ' ')) as key from part"

_MATCH = """select k.key, c.file, cast(c.line_no as integer) as line_no, c.context
from keys k join ctx c on contains(c.line, k.key)"""


def _code_keys(spark, sf):
    src = fx.source_entries(spark, sf).select("key")
    return src.unionByName(fx.part_word_keys(spark, sf)).distinct()


@register("usage_extract_keys", with_(cf=_CODE_FILES, ln=_LINES) + """
select key, file, cast(line_no as integer) as line from (
  select unnest(regexp_extract_all(line, 't\\(\\s*[''"]([^''"]+)[''"]', 1)) as key, file, line_no from ln)""")
def usage_extract_keys(spark, sf):
    return U.extract_keys(fx.code_files_from_parts(spark, sf))


@register("usage_context", with_(cf=_CODE_FILES, ln=_LINES, ctx=_CTX, keys=_CODE_KEYS) + _MATCH)
def usage_context(spark, sf):
    return U.key_contexts(_code_keys(spark, sf), fx.code_files_from_parts(spark, sf))


@register("usage_context_docs", with_(cf=_DOC_FILES, ln=_LINES, ctx=_CTX, keys=_WORD_KEYS) + _MATCH)
def usage_context_docs(spark, sf):
    return U.key_contexts(fx.part_word_keys(spark, sf), fx.document_files(spark, sf))


_TOP = """, m as (""" + _MATCH + """)
, top as (select *, cast(row_number() over (partition by key order by file, line_no) as integer) as rank from m)"""


@register("usage_context_topn", with_(cf=_CODE_FILES, ln=_LINES, ctx=_CTX, keys=_CODE_KEYS) + _TOP + """
select key, file, line_no, context, rank from top where rank <= 3""")
def usage_context_topn(spark, sf):
    return U.first_contexts(U.key_contexts(_code_keys(spark, sf), fx.code_files_from_parts(spark, sf)))


@register("usage_context_text", with_(cf=_CODE_FILES, ln=_LINES, ctx=_CTX, keys=_CODE_KEYS) + _TOP + """
, b as (select key, string_agg(concat('- ', file, ':', cast(line_no as varchar), chr(10), '  ',
                                      replace(context, chr(10), chr(10) || '  ')), chr(10) order by rank) as b
        from top where rank <= 3 group by key)
, allk as (select key from keys union select 'no.such.key')
select a.key, case when b.b is null then concat('Key "', a.key, '" - no usage context found')
                   else concat('Key "', a.key, '" is used in:', chr(10), b.b) end as text
from allk a left join b on a.key = b.key""")
def usage_context_text(spark, sf):
    keys = _code_keys(spark, sf)
    asked = keys.unionByName(spark.range(1).select(F.lit("no.such.key").alias("key")))
    return U.context_text(asked, U.key_contexts(keys, fx.code_files_from_parts(spark, sf)))


@register("usage_stats", with_(cf=_DOC_FILES, ln=_LINES, ctx=_CTX, keys=_WORD_KEYS) + """
, m as (""" + _MATCH + """)
, per as (select key, count(*) as c from m group by key)
select cast(coalesce(sum(c), 0) as bigint) as n_contexts, count(*) filter (where c > 0) as n_keys_with_context,
       count(*) as n_keys
from keys left join per using (key)""")
def usage_stats(spark, sf):
    keys = fx.part_word_keys(spark, sf)
    return U.context_stats(keys, U.key_usages(keys, fx.document_files(spark, sf)))


@register("usage_status", with_(cf=_CODE_FILES, ln=_LINES, tgt=TGT_DUP) + """
, u as (select key, count(*) as n from (
          select unnest(regexp_extract_all(line, 't\\(\\s*[''"]([^''"]+)[''"]', 1)) as key from ln) group by key)
, c as (select distinct key from tgt)
select coalesce(u.key, c.key) as key, coalesce(u.n, 0) as n_usages,
       case when c.key is null then 'undefined' when u.key is null then 'unused' else 'used' end as status
from u full join c on u.key = c.key""")
def usage_status(spark, sf):
    usages = U.extract_keys(fx.code_files_from_parts(spark, sf))
    return U.usage_status(usages, fx.target_entries_dup(spark, sf))


@register("usage_contexts_per_key", with_(cf=_CODE_FILES, ln=_LINES, ctx=_CTX, keys=_CODE_KEYS) + _TOP + """
, allk as (select key from keys union select 'no.such.key')
select a.key, t.file, t.line_no, t.context
from allk a left join top t on t.key = a.key""")
def usage_contexts_per_key(spark, sf):
    keys = _code_keys(spark, sf)
    asked = keys.unionByName(spark.range(1).select(F.lit("no.such.key").alias("key")))
    return U.contexts_per_key(asked, U.key_contexts(keys, fx.code_files_from_parts(spark, sf)))


@register("usage_code_tree", """
with x as (
  select p_partkey as k, p_name, concat('t(''part.', cast(p_partkey as varchar), '.name'')') as line,
         lower(replace(p_brand, '#', '_')) as app, floor(p_partkey / 200) as blk, p_partkey % 6 as r
  from part)
, f as (
  select concat(app, '/', case r when 0 then 'pages/_app' when 1 then '.hidden/b' when 2 then 'src/b' when 3 then 'src/_b'
                          when 4 then 'node_modules/b' else 'docs/b' end,
                cast(cast(blk as bigint) as varchar), case when r = 5 then '.md' else '.tsx' end) as file,
         count(*) as n, sum(length(line) + 1) as n_chars, r
  from x group by 1, r)
select file, n_chars, n as n_keys from f where r not in (4, 5)""")
def usage_code_tree(spark, sf):
    """A tree written from the parts, with names of every kind, then scanned: what is read of it, and its keys by file."""
    p = fx.table(spark, sf, "part")
    k, r = F.col("p_partkey"), F.col("p_partkey") % 6
    folder = (F.when(r == 0, "pages/_app").when(r == 1, ".hidden/b").when(r == 2, "src/b").when(r == 3, "src/_b")
              .when(r == 4, "node_modules/b").otherwise("docs/b"))
    place = F.concat(F.lower(F.regexp_replace("p_brand", "#", "_")), F.lit("/"), folder, F.floor(k / 200).cast("bigint").cast("string"),
                     F.when(r == 5, ".md").otherwise(".tsx"))
    line = F.concat(F.lit("t('part."), k.cast("string"), F.lit(".name')"))
    root = new_work_path(spark, "code-tree")
    write_files(p.groupBy(place.alias("path")).agg(F.array_join(F.sort_array(F.collect_list(line)), "\n").alias("content")), root)
    found = S.scan_code(spark, root, extensions=["tsx"])
    code = found.files.select(F.col("path").alias("file"), "content")
    keys = U.extract_keys(code).groupBy("file").agg(F.count(F.lit(1)).alias("n_keys"))
    return code.select("file", F.length("content").cast("bigint").alias("n_chars")).join(keys, "file").unionByName(
        found.rejects.select(F.col("path").alias("file"), F.lit(-1).cast("bigint").alias("n_chars"), F.lit(0).cast("bigint").alias("n_keys")))
