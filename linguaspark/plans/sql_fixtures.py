"""The derived fixture relations of ``fixtures.py`` as SQL CTE bodies (DuckDB dialect)."""

PART_KEY = "concat('part.', cast(p_partkey as varchar), '.name')"

SRC = f"""select p_brand as catalog, 'en' as lang, {PART_KEY} as key, p_name as value,
       p_partkey as ord from part"""

SRC_DUP = SRC + f"""
union all
select p_brand as catalog, 'en' as lang, {PART_KEY} as key, concat(p_name, ' v2') as value,
       p_partkey + 1000000000 as ord from part where p_partkey % 13 = 0"""

TGT = f"""select p_brand as catalog, 'ja' as lang, {PART_KEY} as key,
       case when p_partkey % 3 = 0 then p_name when p_partkey % 7 = 0 then '' else upper(p_name) end as value,
       p_partkey as ord from part where p_partkey % 5 <> 0"""

TGT_DUP = TGT + f"""
union all
select p_brand as catalog, 'ja' as lang, {PART_KEY} as key, concat('new ', p_name) as value,
       p_partkey + 1000000000 as ord from part where p_partkey % 11 = 0"""

TGT_LAST = """select catalog, lang, key, arg_max(value, ord) as value, max(ord) as ord,
       min(ord) as first_ord from tgt group by catalog, lang, key"""

INCOMING = f"""select p_brand as catalog, 'ja' as lang, {PART_KEY} as key,
       case when p_partkey % 17 = 0 then '' else concat('imp ', p_name) end as value,
       p_partkey as seq from part where p_partkey % 4 = 0
union all
select p_brand, 'ja', concat('part.', cast(p_partkey as varchar), '.desc'), concat('desc ', p_type),
       p_partkey + 1000000000 from part where p_partkey % 9 = 0
union all
select p_brand, 'ja', concat('part.', cast(p_partkey as varchar), '.desc'), concat('desc2 ', p_type),
       p_partkey + 2000000000 from part where p_partkey % 18 = 0"""

NATION_ROWS = """select r_name as catalog, 'en' as lang, concat('nation.', n_name, '.key') as key,
       cast(n_nationkey as varchar) as value
from nation join region on n_regionkey = r_regionkey"""

CODE_LINES = """select concat('src/', lower(replace(p_brand, '#', '_')), '/b',
              cast(cast(floor(p_partkey / 100) as bigint) as varchar), '.jsx') as file,
       p_partkey, p_name,
       row_number() over (partition by p_brand, floor(p_partkey / 100) order by p_partkey) as rn
from part"""

PAIRS = """select u.conv_id, u.turn, concat('l', cast(u.conv_id % 4 as varchar)) as lang,
       u.text as source_text, a.text as translation
from conversations u
join conversations a on a.conv_id = u.conv_id and a.turn = u.turn + 1
where u.role = 'user' and a.role = 'assistant'"""

GLOSS_LONG = """select n_name as term, lower(r_name) as lang, concat('g:', n_name) as translation,
       concat('nation ', cast(n_nationkey as varchar)) as context, cast(null as varchar) as notes,
       cast(n_nationkey as bigint) as seq
from nation join region on n_regionkey = r_regionkey where n_nationkey < 20"""

GLOSS_IN = """select lower(n_name) as term, concat('i:', lower(n_name)) as translation,
       case when n_nationkey % 2 = 0 then 'imported' end as context,
       case when n_nationkey % 3 = 0 then 'note' end as notes,
       cast(n_nationkey + 100 as bigint) as seq
from nation where n_nationkey >= 15"""


def with_(**ctes: str) -> str:
    """``with a as (...), b as (...)`` from keyword CTE bodies."""
    return "with " + ",\n".join(f"{k} as (\n{v}\n)" for k, v in ctes.items()) + "\n"
