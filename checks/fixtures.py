"""Snapshot-shaped views over the given tables.

Each text runs unchanged in Spark and in DuckDB, so a query and its SQL
counterpart start from the same rows. No backslashes: Spark would read them as
escapes. Every fixture reads its tables whole.
"""

from __future__ import annotations

# One value shape per customer: a hit and a near miss for every detector.
_VALUE = """case c_custkey % 24
  when 0 then concat('user', {K}, '@mail.example.com')
  when 1 then concat('10.', cast(c_custkey % 256 as varchar(20)), '.7.', cast(c_custkey % 200 as varchar(20)))
  when 2 then concat('+33 6', lpad({K}, 8, '0'))
  when 3 then concat('FR76 ', lpad({K}, 20, '0'))
  when 4 then md5({K})
  when 5 then concat('eyJhbGciOiJIUzI1NiJ9.eyJzdWIi', lpad({K}, 8, '0'), '.sig')
  when 6 then concat('$2b$10$', md5({K}))
  when 7 then concat('{"user":[1,{"email":"u', {K}, '"}]}')
  when 8 then concat('fe80::', lpad({K}, 4, '0'))
  when 9 then concat('4', lpad({K}, 15, '0'))
  when 10 then concat('ABCDEFGHIJKLMNOPQRSTUVWXYZabcd_', lpad({K}, 15, '0'))
  when 11 then c_name
  when 12 then concat('user', {K}, '@mail')
  when 13 then concat('10.1.2.3.', {K})
  when 14 then concat('0033 6', lpad({K}, 8, '0'))
  when 15 then concat('fr76', lpad({K}, 20, '0'))
  when 16 then upper(md5({K}))
  when 17 then concat('{"a":[', {K}, ',{"status":"x"}]}')
  when 18 then concat('{"email":', {K}, '} trailing')
  when 19 then concat('{"note":"email: ', {K}, '"}')
  when 20 then concat('u', {K}, '@x.io', chr(10))
  when 21 then concat('4111 1111-1111 ', lpad(cast(c_custkey % 10000 as varchar(20)), 4, '0'))
  when 22 then concat('12:34:', lpad(cast(c_custkey % 60 as varchar(20)), 2, '0'))
  else '' end""".replace("{K}", "cast(c_custkey as varchar(20))")
VALUES = f"select c_custkey as id, {_VALUE} as v from customer"

# Persons with fields sensitive by name, by value and not at all.
PEOPLE = f"""
select c_custkey as person_no, c_nationkey as nation,
  case when c_custkey % 10 = 0 then null
    else concat(lower(substring(c_mktsegment, 1, 4)), cast(c_custkey as varchar(20)), '@mail.example.com') end as email,
  c_name as Full_Name, c_acctbal as tax_id, c_mktsegment as segment, {_VALUE} as note
from customer
"""

PURCHASES = """
select o_orderkey as order_no, o_custkey as person_no, o_orderstatus as status,
  cast(round(o_totalprice * 100) as bigint) as cents
from orders
"""

# Statement texts, allowed and not, with the guard's odd corners.
STATEMENTS = """
select event_id, case event_id % 20
  when 0 then concat('select ', event_type, ' from parcels where weight > ', cast(user_id as varchar(20)))
  when 1 then 'with heavy as (table parcels) table heavy'
  when 2 then concat('with', chr(9), 'heavy as (table parcels) table heavy')
  when 3 then concat('delete from parcels where id = ', cast(user_id as varchar(20)))
  when 4 then '/* truncate, later */ show work_mem'
  when 5 then concat('-- alter nothing', chr(10), 'fetch 3 from walk')
  when 6 then 'create view boxes as table parcels'
  when 7 then 'create extension hstore'
  when 8 then 'select ''never drop a parcel'''
  when 9 then 'close walk'
  when 10 then concat('create', chr(10), 'extension hstore')
  when 11 then concat(chr(13), ' ANALYZE parcels ', chr(9))
  when 12 then 'explain table parcels /* open end'
  when 13 then 'show all; grant all to clerk'
  when 14 then 'select updates, dropped, alternate from parcels'
  when 15 then 'deallocate plan_7'
  when 16 then '/* fine */ revoke all on parcels from clerk'
  when 17 then 'declare walk cursor for table parcels'
  when 18 then concat('select weight -- insert', chr(10), 'from parcels')
  else 'select weight from recreate' end as q
from events
"""

# Signs of comments inside literals, and literals inside comments.
QUOTED_STATEMENTS = """
select event_id, case event_id % 14
  when 0 then concat('select ''--'' as dashes; drop table t', cast(user_id as varchar(20)))
  when 1 then 'select ''/*'' ; delete from t; select ''*/'''
  when 2 then 'select ''please drop this'' from parcels'
  when 3 then 'select "update" from parcels'
  when 4 then '/* it''s open */ select 1 -- don''t'
  when 5 then concat('select $$drop -- it$$ from parcels ', chr(10), '-- insert')
  when 6 then concat('select 1 ', chr(10), '/* '' */ ; truncate parcels /* '' */')
  when 7 then 'select ''a''''; drop table b'' from c'
  when 8 then 'select ''open; drop table c'
  when 9 then concat('select E''a', chr(92), '''; grant all'' from c')
  when 10 then concat('select E''', chr(92), chr(92), '''; revoke all from c')
  when 11 then 'insert into t values (''select'')'
  when 12 then 'select "a""b; alter" from c /* never closed; drop'
  else 'show all' end as q
from events
"""

LOG_LINES = """
select event_id, case event_id % 12
  when 0 then concat('postgres://clerk:pw', {U}, '@depot/parcels')
  when 1 then concat('postgresql://clerk:at@', {U}, '@depot.internal:5432/parcels')
  when 2 then concat('port=5433 password=', {U}, 'q dbname=parcels')
  when 3 then concat('password =  ''two ', {U}, '''')
  when 4 then concat('port=5433 dbname=parcels', {U})
  when 5 then concat('retry ', {U}, ': postgres://a:1 ', {U}, '@x/p, postgres://b:2@y/p')
  when 6 then concat('set PassWord="two ', {U}, '";')
  when 7 then concat('ftp://c:', {U}, '@files.internal/x?password=', {U})
  when 8 then concat('pAssword=', {U}, '&password=', {U}, '''')
  when 9 then concat('ftp://files.internal/', {U}, '@2x')
  when 10 then concat('amqp://c:1:', {U}, '@172.16.0.9')
  else props end as line
from events
""".replace("{U}", "cast(user_id as varchar(20))")

# A raw log of executions: a third of it from one database.
EXECUTIONS = """
select case when l_partkey % 3 = 0 then 0 else l_suppkey % 20 + 1 end as db_id,
  concat('q', cast(case when l_quantity <= 10 then 0 when l_quantity <= 18 then 1
                        when l_quantity <= 24 then 2 else cast(l_quantity as int) end as varchar(20))) as query,
  cast(round(l_extendedprice * 100) as bigint) as exec_time, l_linenumber as n_rows,
  cast(l_quantity as int) as hit, l_linenumber as rd,
  case when l_returnflag = 'R' then 1 else 0 end as dirt, l_partkey as wal
from lineitem
"""

# The same as statement statistics.
STATEMENT_STATS = f"""
select db_id, query, count(*) as calls, cast(sum(n_rows) as bigint) as rows,
  cast(sum(exec_time) as double) as total_exec_time,
  cast(sum(exec_time) as double) / count(*) as mean_exec_time,
  cast(max(exec_time) - min(exec_time) as double) as stddev_exec_time,
  cast(sum(hit) as bigint) as shared_blks_hit, cast(sum(rd) as bigint) as shared_blks_read,
  cast(sum(dirt) as bigint) as shared_blks_dirtied, cast(sum(wal) as bigint) as wal_bytes
from ({EXECUTIONS}) e group by db_id, query
"""

# Column names as a catalog would list them.
COLUMN_NAMES = """
select p_partkey as id, case p_partkey % 12
  when 0 then 'user_email' when 1 then 'redirect_url' when 2 then 'Hashed_Password'
  when 3 then 'status' when 4 then 'photo_s3_url' when 5 then 'keyboard_layout'
  when 6 then 'user_id' when 7 then 'HomeAddress' when 8 then 'BIRTHDATE'
  when 9 then concat(replace(p_name, ' ', '_'), '_token')
  when 10 then replace(p_name, ' ', '_')
  else lower(p_type) end as column_name
from part
"""

SCHEMATA = """
select c_nationkey as db_id, case c_custkey % 5
    when 0 then concat('pg_', {K}) when 1 then concat('pgx', {K})
    when 2 then 'information_schema' when 3 then lower(c_name) else concat('pg', {K}) end as schema_name,
  c_mktsegment as schema_owner
from customer
""".replace("{K}", "cast(c_custkey as varchar(20))")

TABLES = """
select p_size % 4 as db_id, p_brand as table_schema,
  concat(replace(p_name, ' ', '_'), '_', cast(p_partkey as varchar(20))) as table_name,
  case p_partkey % 3 when 0 then 'BASE TABLE' when 1 then 'VIEW' else 'LOCAL TEMPORARY' end as table_type
from part
"""

SEQUENCES = """
select s_nationkey as db_id, case when s_suppkey % 3 = 0 then 'public' else 'app' end as sequence_schema,
  concat('seq_', cast(s_suppkey as varchar(20))) as sequence_name,
  case when s_suppkey % 2 = 0 then 'bigint' else 'integer' end as data_type,
  '1' as start_value, '1' as increment
from supplier
"""

EXTENSIONS = """
select s_nationkey as db_id, concat('ext_', cast(s_suppkey as varchar(20))) as extname,
  concat('1.', cast(s_suppkey % 7 as varchar(20))) as extversion, s_suppkey % 2 = 0 as extrelocatable
from supplier
"""

# Every order is a table, its line numbers are columns. The name "pk" repeats
# in all tables of a schema; check constraints have no columns.
TABLE_COLUMNS = """
select l_orderkey % 10 as db_id, concat('s', cast(l_orderkey % 7 as varchar(20))) as table_schema,
  concat('t', cast(l_orderkey as varchar(20))) as table_name,
  concat('col_', cast(l_linenumber as varchar(20))) as column_name, l_linenumber as ordinal_position,
  case l_linenumber % 3 when 0 then 'integer' when 1 then 'text' else 'numeric' end as data_type,
  case when max(l_tax) > 0.04 then 'YES' else 'NO' end as is_nullable,
  case when l_linenumber = 1 then 'nextval(''x'')' else null end as column_default
from lineitem group by l_orderkey, l_linenumber
"""
TABLE_CONSTRAINTS = """
select o_orderkey % 10 as db_id, concat('s', cast(o_orderkey % 7 as varchar(20))) as table_schema,
  concat('t', cast(o_orderkey as varchar(20))) as table_name, 'pk' as constraint_name,
  'PRIMARY KEY' as constraint_type
from orders
union all
select o_orderkey % 10, concat('s', cast(o_orderkey % 7 as varchar(20))),
  concat('t', cast(o_orderkey as varchar(20))), concat('ck_', cast(o_custkey as varchar(20))), 'CHECK'
from orders
"""
KEY_COLUMNS = """
select l_orderkey % 10 as db_id, concat('s', cast(l_orderkey % 7 as varchar(20))) as table_schema,
  concat('t', cast(l_orderkey as varchar(20))) as table_name, 'pk' as constraint_name,
  concat('col_', cast(l_linenumber as varchar(20))) as column_name, l_linenumber as ordinal_position
from lineitem group by l_orderkey, l_linenumber
"""
TABLE_INDEXES = """
select o_orderkey % 10 as db_id, concat('s', cast(o_orderkey % 7 as varchar(20))) as schemaname,
  concat('t', cast(o_orderkey as varchar(20))) as tablename,
  concat('ix_', cast(o_orderkey as varchar(20))) as indexname,
  concat('CREATE INDEX ON t USING btree (col_', cast(o_custkey % 7 as varchar(20)), ')') as indexdef
from orders
"""

# ---- catalog of indexes: every part is an index on the table of its brand ----

_DB = "p_size % 4"
_T = "cast(substring(p_brand, 7) as bigint)"
_K = "cast(p_partkey as varchar(20))"
_COLS = (
    "case p_partkey % 5 when 0 then p_type when 1 then concat(p_type, ', \"', p_name, '\"') "
    "when 2 then concat('\"', p_name, '\"') when 3 then concat(p_type, ', \"', p_name, '\", lower(x)') "
    "else concat(p_type, ') WHERE (', 'deleted') end"
)

PG_NAMESPACE = f"""
select distinct {_DB} as db_id, {_T} % 3 + 1 as oid, concat('schema_', cast({_T} % 3 as varchar(20))) as nspname
from part
union all
select distinct {_DB}, cast(99 as bigint), 'pg_temp_1' from part
"""
PG_AM = f"""
select distinct {_DB} as db_id, cast(403 as bigint) as oid, 'btree' as amname from part
union all select distinct {_DB}, cast(405 as bigint), 'hash' from part
"""
PG_CLASS = f"""
select {_DB} as db_id, {_T} as oid, max(p_brand) as relname,
  case when {_T} = 25 then cast(99 as bigint) else {_T} % 3 + 1 end as relnamespace, 'r' as relkind,
  cast(0 as bigint) as relam, 0e0 as reltuples, cast(0 as bigint) as relpages,
  case when {_T} % 4 = 0 then cast(0 as bigint) else {_T} + 500 end as reltoastrelid,
  cast(max(p_partkey) % 7 * 400000000 as bigint) as xid_age
from part group by {_DB}, {_T}
union all
select distinct {_DB}, {_T} + 500, concat('toast_', p_brand), {_T} % 3 + 1, 't', cast(0 as bigint), 0e0,
  cast(0 as bigint), cast(0 as bigint), 2140000000 + {_T} % 2 * 6000000
from part
union all
select {_DB}, p_partkey + 1000, concat('ix_', {_K}), {_T} % 3 + 1, 'i',
  case when p_partkey % 9 = 0 then cast(405 as bigint) else cast(403 as bigint) end,
  cast(p_partkey * 1000 as double), cast(p_size * 2000 as bigint), cast(0 as bigint), cast(0 as bigint)
from part
"""
PG_INDEX = f"""
select {_DB} as db_id, p_partkey + 1000 as indexrelid, {_T} as indrelid,
  concat(cast(p_size % 6 + 1 as varchar(20)), ' ', cast((p_size + 1) % 6 + 1 as varchar(20))) as indkey,
  p_partkey % 7 = 0 as indisunique, p_partkey % 11 = 0 as indisprimary, p_partkey % 13 <> 0 as indisvalid,
  case when p_partkey % 5 = 3 then 'lower(x)' else null end as indexprs,
  case when p_partkey % 5 = 4 then 'deleted' else null end as indpred,
  concat('CREATE INDEX ix_', {_K}, ' ON schema_0.t USING ',
    case when p_partkey % 9 = 0 then 'hash' else 'btree' end, ' (', {_COLS}, ')') as indexdef,
  cast(p_size * 2000 * 8192 as bigint) as size_bytes
from part
"""
PG_STAT_USER_INDEXES = f"""
select {_DB} as db_id, p_partkey + 1000 as indexrelid,
  case when p_partkey % 17 = 0 then null else concat('schema_', cast({_T} % 3 as varchar(20))) end as schemaname,
  p_brand as relname, concat('ix_', {_K}) as indexrelname, p_partkey % 120 as idx_scan
from part
"""
PG_ATTRIBUTE = f"""
select distinct {_DB} as db_id, {_T} as attrelid, p_size % 6 + 1 as attnum,
  concat('a', cast(p_size % 6 + 1 as varchar(20))) as attname,
  case p_size % 3 when 0 then 'integer' when 1 then 'bigint' else 'smallint' end as column_type,
  p_size % 6 = 5 as attisdropped
from part
"""
PG_STATS = f"""
select distinct {_DB} as db_id, concat('schema_', cast({_T} % 3 as varchar(20))) as schemaname,
  p_brand as tablename, concat('a', cast(p_size % 6 + 1 as varchar(20))) as attname,
  case p_size % 3 when 0 then 0.25e0 when 1 then 0e0 else null end as null_frac,
  case when p_size % 6 = 4 then null else cast(p_size % 6 * 3 + 1 as int) end as avg_width
from part
"""
PG_ATTRDEF = f"""
select distinct {_DB} as db_id, {_T} as adrelid, p_size % 6 + 1 as adnum,
  case ({_T} + p_size % 6) % 5
    when 0 then concat('nextval(''app.', p_brand, '_a', cast(p_size % 6 + 1 as varchar(20)), '''::regclass)')
    when 1 then concat('nextval(''', p_brand, '_a', cast(p_size % 6 + 1 as varchar(20)), '''::regclass)')
    when 2 then concat('nextval((''"app"."', p_brand, '_a', cast(p_size % 6 + 1 as varchar(20)), '"''::text)::regclass)')
    when 3 then 'uuid_generate_v4()'
    else 'nextval(currval())' end as default_value
from part
"""
PG_SEQUENCES = f"""
select {_DB} as db_id, case when ({_T} + p_size % 6) % 5 = 1 then 'public' else 'app' end as schemaname,
  concat(p_brand, '_a', cast(p_size % 6 + 1 as varchar(20))) as sequencename,
  case when {_T} % 6 = 0 then null else 1073741824 + max(p_partkey) % 100 * 10737418 end as last_value,
  {_T} % 7 <> 0 as readable
from part
group by {_DB}, case when ({_T} + p_size % 6) % 5 = 1 then 'public' else 'app' end,
  concat(p_brand, '_a', cast(p_size % 6 + 1 as varchar(20))), {_T}
"""
PG_CONSTRAINT = f"""
select {_DB} as db_id, p_partkey + 5000000 as oid, concat('con_', {_K}) as conname, {_T} as conrelid,
  case when p_partkey % 3 = 0 then cast(0 as bigint) else {_T} % 25 + 1 end as confrelid,
  {_T} % 3 + 1 as connamespace, p_partkey % 4 <> 0 as convalidated
from part
"""

# ---- statistics ----

CONNECTIONS = """
select case when user_id < 75 then 0 when user_id < 81 then 1 else user_id % 30 + 2 end as db_id,
  case when event_type in ('error', 'signup') then 'idle in transaction' else 'active' end as state
from events
"""
# Ids start at 1: 0 stands for no relation.
RELATIONS = """
select cast(o_custkey % 10 as bigint) as db_id, o_orderkey + 1 as oid, concat('t', cast(o_orderkey as varchar(20))) as relname,
  cast(o_custkey % 5 + 1 as bigint) as relnamespace, case when o_orderkey % 8 = 0 then 'm' else 'r' end as relkind,
  case when o_orderkey % 3 = 0 then cast(0 as bigint) else o_orderkey + 100000001 end as reltoastrelid,
  2146483648 - cast(round(o_totalprice * 100) as bigint) as xid_age
from orders
union all
select cast(o_custkey % 10 as bigint), o_orderkey + 100000001, 'toast', cast(o_custkey % 5 + 1 as bigint), 't', cast(0 as bigint),
  2146483648 - cast(round(o_totalprice * 100) as bigint) + o_orderkey % 5
from orders
"""
RELATION_SCHEMAS = """
select distinct cast(o_custkey % 10 as bigint) as db_id, cast(o_custkey % 5 + 1 as bigint) as oid,
  concat('schema_', cast(o_custkey % 5 as varchar(20))) as nspname
from orders
"""
REPLICATION = """
select o_orderkey as db_id, o_orderstatus = 'F' as in_recovery,
  concat('0/', cast(o_custkey % 50 as varchar(20))) as receive_lsn,
  case when o_orderkey % 7 = 0 then null else concat('0/', cast(o_custkey % 49 as varchar(20))) end as replay_lsn,
  case when o_orderkey % 11 = 0 then null else o_orderdate end as last_replay_at, o_orderkey % 3 as senders
from orders
"""
AS_OF = "2003-01-01 00:00:00"
SLOTS = """
select c_nationkey as db_id, concat('slot_', cast(c_custkey as varchar(20))) as slot_name,
  c_mktsegment as database, c_custkey % 4 <> 0 as active
from customer
"""
BLOCK_IO = """
select case when l_partkey % 3 = 0 then 0 else l_suppkey % 20 + 1 end as db_id,
  case when l_suppkey % 20 = 7 and l_partkey % 3 <> 0 then cast(0 as bigint) else cast(l_quantity as bigint) end as hit,
  case when l_suppkey % 20 = 7 and l_partkey % 3 <> 0 then cast(0 as bigint)
       when l_suppkey % 20 = 8 then cast(l_linenumber % 2 as bigint) else cast(l_linenumber as bigint) end as rd
from lineitem
"""
INDEX_IO = f"select db_id, hit as idx_blks_hit, rd as idx_blks_read from ({BLOCK_IO}) b"
TABLE_IO = f"select db_id, rd * 9 as heap_blks_hit, hit % 2 as heap_blks_read from ({BLOCK_IO}) b"
