"""Queries over the standard tables, one for each operator, with their SQL.

An entry is the text of a query, the SQL that must give the same rows, and the
columns whose doubles are rounded to so many digits on both sides, because the
order of additions is free.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .api import Engine
from .plans.relation import column

ORDERS = {
    "region": ["r_regionkey"], "nation": ["n_nationkey"], "customer": ["c_custkey"], "supplier": ["s_suppkey"], "part": ["p_partkey"], "orders": ["o_orderkey"],
    "lineitem": ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"], "events": ["event_id"], "documents": ["doc_id"], "pages": ["page_id"],
    "embeddings": ["vec_id"], "benchmark": ["item_id"], "labels": ["doc_id"], "conversations": ["conv_id", "turn"],
}
Q: dict[str, tuple] = {}


def q(name: str, text: str, sql: str | None, digits: dict[str, int] | None = None) -> None:
    Q[name] = (text, sql, digits or {})


# navigation, filters, projections
q("q_field", "$.customer.map(c_name)", "SELECT c_name AS value FROM customer")
q("q_filter", "$.lineitem.filter(l_quantity > 45 and l_returnflag == 'R').map({l_orderkey, l_partkey, l_quantity})",
  "SELECT l_orderkey, l_partkey, l_quantity FROM lineitem WHERE l_quantity > 45 AND l_returnflag = 'R'")
q("q_find_multi", "$.orders.find(o_orderstatus == 'F', o_orderpriority == '1-URGENT').map(o_orderkey)",
  "SELECT o_orderkey AS value FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'")
q("q_find_all", "$.part.find_all(p_size < 3).map({p_partkey, p_size: p_size as int})", "SELECT p_partkey, CAST(p_size AS BIGINT) AS p_size FROM part WHERE p_size < 3")
q("q_find_first", "$.orders.find_first(o_totalprice > 200000).o_orderkey", "SELECT o_orderkey AS value FROM orders WHERE o_totalprice > 200000 ORDER BY o_orderkey LIMIT 1")
q("q_find_one", "$.part.find_one(p_size == 7).p_partkey", "SELECT p_partkey AS value FROM part WHERE p_size = 7 ORDER BY p_partkey LIMIT 1")
q("q_inline_filter", "$.nation{n_regionkey == 2}.map(n_name)", "SELECT n_name AS value FROM nation WHERE n_regionkey = 2")
q("q_exactly_one", "$.nation{n_nationkey == 7}!.n_name", "SELECT n_name AS value FROM nation WHERE n_nationkey = 7")
q("q_map_into_shape", "$.customer[* if c_acctbal < 0] => {id: c_custkey, owes: -c_acctbal}", "SELECT c_custkey AS id, -c_acctbal AS owes FROM customer WHERE c_acctbal < 0")
q("q_compact", "$.orders.map(o_orderkey if o_orderstatus == 'P' else null).compact()", "SELECT o_orderkey AS value FROM orders WHERE o_orderstatus = 'P'")
q("q_remove", "$.orders.map(o_orderpriority).remove('5-LOW').count()", "SELECT count(*) AS value FROM orders WHERE o_orderpriority <> '5-LOW'")
q("q_remove_lambda", "$.part.remove(p => p.p_size > 5).map(p_partkey)", "SELECT p_partkey AS value FROM part WHERE NOT p_size > 5")
q("q_map_shape", "$.customer.map({id: c_custkey, name: c_name, rich: c_acctbal > 5000})", "SELECT c_custkey AS id, c_name AS name, c_acctbal > 5000 AS rich FROM customer")
q("q_pick_alias", "$.customer.pick(c_custkey, who: c_name)", "SELECT c_custkey, c_name AS who FROM customer")
q("q_omit", "$.customer.omit(c_nationkey, c_acctbal)", "SELECT c_custkey, c_name, c_mktsegment FROM customer")
q("q_rename", "$.region.rename({r_name: 'label'}).map({label})", "SELECT r_name AS label FROM region")
q("q_flat_map_words", "$.documents.flat_map(text.words())", "SELECT unnest(regexp_extract_all(text, '[^\\s\\x{85}\\x{a0}]+')) AS value FROM documents")
q("q_explode", "$.embeddings.map({vec_id, d: embedding[0:4]}).explode(d).map({vec_id, d: d as float})",
  "SELECT vec_id, CAST(unnest(embedding[1:4]) AS DOUBLE) AS d FROM embeddings")
q("q_implode", "$.orders.map({o_custkey, o_orderkey}).implode(o_orderkey).map({o_custkey, keys: o_orderkey.join(',')})",
  "SELECT o_custkey, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS keys FROM orders GROUP BY o_custkey")
q("q_flatten", "$.embeddings.map(embedding[0:2]).flatten().map(@ as float)", "SELECT CAST(unnest(embedding[1:2]) AS DOUBLE) AS value FROM embeddings")
q("q_explode_whole", "$.embeddings.map({vec_id, d: embedding}).explode(d).map({vec_id, d: d as float})",
  "SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS d FROM embeddings")
q("q_flatten_whole", "$.embeddings.map(embedding).flatten().map(@ as float)", "SELECT CAST(unnest(embedding) AS DOUBLE) AS value FROM embeddings")
q("q_collect", "$.nation.collect().map(n_name)", "SELECT n_name AS value FROM nation")
q("q_enumerate", "$.events.map(event_type).enumerate()", "SELECT row_number() OVER (ORDER BY event_id) - 1 AS index, event_type AS value FROM events")
q("q_pairwise", "$.events.map(event_id).pairwise().map({a: @[0], b: @[1]})", "SELECT * FROM (SELECT event_id AS a, lead(event_id) OVER (ORDER BY event_id) AS b FROM events) WHERE b IS NOT NULL")
q("q_partition", "$.orders.map(o_orderkey).partition(@ % 2 == 0) -> {...r} | {even: r.true.len(), odd: r.false.len()}",
  "SELECT count(*) FILTER (WHERE o_orderkey % 2 = 0) AS even, count(*) FILTER (WHERE o_orderkey % 2 <> 0) AS odd FROM orders")
q("q_fanout", "$.part.map(p_size.fanout(@ + 1, @ * 2).join('|'))", "SELECT (p_size + 1) || '|' || (p_size * 2) AS value FROM part")
q("q_zip_shape", "$.part.map(@.zip_shape(n: p_name.len(), p_size)).map({n, p_size: p_size as int})", "SELECT length(p_name) AS n, CAST(p_size AS BIGINT) AS p_size FROM part")
q("q_flat_map_lookup", "$.region.flat_map(r => $.nation.filter(n_regionkey == r.r_regionkey).map(n_name))", "SELECT n_name AS value FROM nation JOIN region ON n_regionkey = r_regionkey")

# positions
q("q_take", "$.orders.take(7).map(o_orderkey)", "SELECT o_orderkey AS value FROM orders ORDER BY o_orderkey LIMIT 7")
q("q_skip", "$.orders.skip(30).take(5).map(o_orderkey)", "SELECT o_orderkey AS value FROM orders ORDER BY o_orderkey LIMIT 5 OFFSET 30")
q("q_drop", "$.nation.drop(20).map(n_name)", "SELECT n_name AS value FROM nation ORDER BY n_nationkey OFFSET 20")
q("q_slice", "$.events[3:6].map(event_id)", "SELECT event_id AS value FROM events ORDER BY event_id LIMIT 3 OFFSET 3")
q("q_first", "$.orders.first().o_custkey", "SELECT o_custkey AS value FROM orders ORDER BY o_orderkey LIMIT 1")
q("q_last", "$.orders.last().o_custkey", "SELECT o_custkey AS value FROM orders ORDER BY o_orderkey DESC LIMIT 1")
q("q_last_n", "$.orders.last(3).map(o_orderkey)", "SELECT o_orderkey AS value FROM orders ORDER BY o_orderkey DESC LIMIT 3")
q("q_nth", "$.events.nth(41).event_id", "SELECT event_id AS value FROM events ORDER BY event_id LIMIT 1 OFFSET 41")
q("q_nth_back", "$.events.nth(-2).event_id", "SELECT event_id AS value FROM events ORDER BY event_id DESC LIMIT 1 OFFSET 1")
q("q_topk", "$.orders.sort(-o_totalprice).take(10).map({o_orderkey, o_totalprice})", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
q("q_take_while", "$.events.take_while(value < 150).map(event_id)",
  "SELECT event_id AS value FROM events WHERE event_id < (SELECT coalesce(min(event_id), 1e18) FROM events WHERE NOT value < 150)")
q("q_drop_while", "$.events.drop_while(value < 150).count()", "SELECT count(*) AS value FROM events WHERE event_id >= (SELECT min(event_id) FROM events WHERE NOT value < 150)")
q("q_find_index", "$.events.find_index(value > 150)", "SELECT count(*) AS value FROM events WHERE event_id < (SELECT min(event_id) FROM events WHERE value > 150)")
q("q_indices_where", "$.events.indices_where(value > 150)", "SELECT i AS value FROM (SELECT value, row_number() OVER (ORDER BY event_id) - 1 AS i FROM events) WHERE value > 150")
q("q_index", "$.events.map(event_type).index('purchase')",
  "SELECT count(*) AS value FROM events WHERE event_id < (SELECT min(event_id) FROM events WHERE event_type = 'purchase')")
q("q_indices_of", "$.events.map(event_type).indices_of('purchase')",
  "SELECT i AS value FROM (SELECT event_type, row_number() OVER (ORDER BY event_id) - 1 AS i FROM events) WHERE event_type = 'purchase'")
q("q_max_by", "$.orders.max_by(o_totalprice).o_orderkey", "SELECT o_orderkey AS value FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1")
q("q_min_by", "$.part.min_by(p_size).p_partkey", "SELECT p_partkey AS value FROM part ORDER BY p_size, p_partkey LIMIT 1")
q("q_max_by_group", "$.orders.group_shape(o_custkey, {best: @.max_by(o_totalprice).o_orderkey})",
  "SELECT CAST(o_custkey AS VARCHAR) AS key, arg_max(o_orderkey, (o_totalprice, -o_orderkey)) AS best FROM orders GROUP BY o_custkey")

# order, distinct, sets
q("q_sort_multi", "$.part.sort(-p_size, p_name).take(12).map({p_partkey, p_name})", "SELECT p_partkey, p_name FROM part ORDER BY p_size DESC, p_name, p_partkey LIMIT 12")
q("q_sort_scalars", "$.customer.map(c_acctbal).sort().take(4)", "SELECT c_acctbal AS value FROM customer ORDER BY c_acctbal LIMIT 4")
q("q_reverse", "$.nation.reverse().take(3).map(n_name)", "SELECT n_name AS value FROM nation ORDER BY n_nationkey DESC LIMIT 3")
q("q_sort_multi_whole", "$.part.sort(-p_size, p_name).map(p_partkey).enumerate()",
  "SELECT row_number() OVER (ORDER BY p_size DESC, p_name, p_partkey) - 1 AS index, p_partkey AS value FROM part")
q("q_sort_scalars_whole", "$.customer.map(c_acctbal).sort().enumerate()", "SELECT row_number() OVER (ORDER BY c_acctbal) - 1 AS index, c_acctbal AS value FROM customer")
q("q_reverse_whole", "$.events.reverse().map(event_type).enumerate()", "SELECT row_number() OVER (ORDER BY event_id DESC) - 1 AS index, event_type AS value FROM events")
q("q_unique", "$.part.map(p_brand).unique()", "SELECT DISTINCT p_brand AS value FROM part")
q("q_unique_by", "$.customer.unique_by(c_nationkey).map(c_custkey)", "SELECT min(c_custkey) AS value FROM customer GROUP BY c_nationkey")
q("q_append", "$.region.map(r_name).append('NOWHERE')", "SELECT r_name AS value FROM region UNION ALL SELECT 'NOWHERE'")
q("q_prepend", "$.region.map(r_name).prepend('NOWHERE').first()", "SELECT 'NOWHERE' AS value")
q("q_diff", "$.customer.map(c_custkey).diff($.orders.map(o_custkey))", "SELECT c_custkey AS value FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
q("q_intersect", "$.nation.map(n_nationkey).intersect($.supplier.map(s_nationkey)).map(@ as int)",
  "SELECT CAST(n_nationkey AS BIGINT) AS value FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier)")
q("q_union", "$.region.map(r_regionkey).union($.nation.map(n_nationkey)).map(@ as int)",
  "SELECT CAST(r_regionkey AS BIGINT) AS value FROM region UNION ALL SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT r_regionkey FROM region)")
q("q_join_text", "$.nation.map(n_name).join(', ')", "SELECT string_agg(n_name, ', ' ORDER BY n_nationkey) AS value FROM nation")
q("q_zip", "$.nation.map(n_name).zip($.region.map(r_name)).map({a: @[0], b: @[1]})",
  "SELECT n_name AS a, r_name AS b FROM (SELECT n_name, row_number() OVER (ORDER BY n_nationkey) i FROM nation) JOIN (SELECT r_name, row_number() OVER (ORDER BY r_regionkey) i FROM region) USING (i)")
q("q_zip_longest", "$.nation.map(n_name).zip_longest($.region.map(r_name), fill: '-').map({a: @[0], b: @[1]})",
  "SELECT coalesce(n_name, '-') AS a, coalesce(r_name, '-') AS b FROM (SELECT n_name, row_number() OVER (ORDER BY n_nationkey) i FROM nation) FULL JOIN (SELECT r_name, row_number() OVER (ORDER BY r_regionkey) i FROM region) USING (i)")
q("q_product", "product($.region.map(r_name), $.region.map(r_name)).map(@.join('/'))", "SELECT a.r_name || '/' || b.r_name AS value FROM region a, region b")
q("q_chain", "chain($.region.map(r_name), $.nation.map(n_name))", "SELECT r_name AS value FROM region UNION ALL SELECT n_name FROM nation")
q("q_range", "range(2, 11, 3).join(',')", "SELECT '2,5,8' AS value")
q("q_window", "$.events.map(event_id).window(3).map(@.join(','))",
  "SELECT a || ',' || (a + 1) || ',' || (a + 2) AS value FROM (SELECT event_id AS a FROM events) WHERE a + 2 <= (SELECT max(event_id) FROM events)")
q("q_chunk", "$.events.map(event_id).chunk(100).map({n: @.len(), s: @.sum()})", "SELECT count(*) AS n, CAST(sum(event_id) AS BIGINT) AS s FROM events GROUP BY event_id // 100")
q("q_includes", "$.part.map(p_brand).includes('Brand#13')", "SELECT bool_or(p_brand = 'Brand#13') AS value FROM part")

# aggregates
q("q_count", "$.lineitem.count()", "SELECT count(*) AS value FROM lineitem")
q("q_len", "$.orders.len()", "SELECT count(*) AS value FROM orders")
q("q_count_pred", "$.lineitem.count(l_discount > 0.05)", "SELECT count(*) AS value FROM lineitem WHERE l_discount > 0.05")
q("q_sum", "$.lineitem.map(l_extendedprice).sum()", "SELECT round(sum(CAST(l_extendedprice AS DECIMAL(18,4)))::DOUBLE, 2) AS value FROM lineitem", {"value": 2})
q("q_sum_int", "$.part.sum(p_size)", "SELECT CAST(sum(p_size) AS BIGINT) AS value FROM part")
q("q_avg", "$.lineitem.avg(l_quantity)", "SELECT round(avg(l_quantity), 6) AS value FROM lineitem", {"value": 6})
q("q_min", "$.lineitem.min(l_extendedprice)", "SELECT min(l_extendedprice) AS value FROM lineitem")
q("q_max", "$.lineitem.map(l_extendedprice).max()", "SELECT max(l_extendedprice) AS value FROM lineitem")
q("q_sum_text", "$.customer.sum(c_name)", "SELECT 0.0::DOUBLE AS value")
q("q_any", "$.orders.any(o_totalprice > 290000)", "SELECT bool_or(o_totalprice > 290000) AS value FROM orders")
q("q_all", "$.orders.all(o_totalprice > 0)", "SELECT bool_and(o_totalprice > 0) AS value FROM orders")
q("q_approx_distinct", "$.lineitem.map(l_partkey).approx_count_distinct()", None)
q("q_distinct_count", "$.lineitem.map(l_suppkey).unique().count()", "SELECT count(DISTINCT l_suppkey) AS value FROM lineitem")
q("q_conjunctive_count", "$.orders.filter(o_orderstatus == 'O' and o_orderpriority == '2-HIGH').count()", "SELECT count(*) AS value FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority = '2-HIGH'")
q("q_group_shape", "$.lineitem.filter(l_quantity > 25).group_shape(l_returnflag, {n: @.count(), qty: @.sum(l_quantity), top: @.max(l_extendedprice), late: @.filter(l_linestatus == 'O').count()})",
  "SELECT l_returnflag AS key, count(*) AS n, round(sum(l_quantity), 2) AS qty, max(l_extendedprice) AS top, count(*) FILTER (WHERE l_linestatus = 'O') AS late FROM lineitem WHERE l_quantity > 25 GROUP BY 1", {"qty": 2})
q("q_group_by_sizes", "$.orders.group_by(o_custkey).transform_values(@.count())", "SELECT CAST(o_custkey AS VARCHAR) AS key, count(*) AS value FROM orders GROUP BY 1")
q("q_group_by_rows", "$.nation.group_by(n_regionkey).transform_values(@.map(n_name).join(','))",
  "SELECT CAST(n_regionkey AS VARCHAR) AS key, string_agg(n_name, ',' ORDER BY n_nationkey) AS value FROM nation GROUP BY n_regionkey")
q("q_group_by_double", "$.lineitem.group_by(l_discount).transform_values(@.count())",
  "SELECT CASE WHEN l_discount = floor(l_discount) THEN CAST(CAST(l_discount AS BIGINT) AS VARCHAR) ELSE CAST(l_discount AS VARCHAR) END AS key, count(*) AS value FROM lineitem GROUP BY l_discount")
q("q_count_by", "$.orders.count_by(o_orderpriority)", "SELECT o_orderpriority AS key, count(*) AS value FROM orders GROUP BY 1")
q("q_index_by", "$.orders.map({o_custkey, o_orderkey}).index_by(o_custkey)",
  "SELECT CAST(o_custkey AS VARCHAR) AS key, o_custkey, max(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey")
q("q_pivot", "$.orders.pivot(o_orderpriority, o_orderstatus, o_totalprice)",
  "SELECT o_orderpriority AS key, arg_max(o_totalprice, o_orderkey) FILTER (WHERE o_orderstatus = 'F') AS F, arg_max(o_totalprice, o_orderkey) FILTER (WHERE o_orderstatus = 'O') AS O, arg_max(o_totalprice, o_orderkey) FILTER (WHERE o_orderstatus = 'P') AS P FROM orders GROUP BY 1")
q("q_pivot_flat", "$.nation.pivot(n_regionkey, n_name)", "SELECT CAST(n_regionkey AS VARCHAR) AS key, arg_max(n_name, n_nationkey) AS value FROM nation GROUP BY n_regionkey")
q("q_accumulate", "$.events.map(event_id).accumulate((a, x) => a + x)", "SELECT CAST(sum(event_id) OVER (ORDER BY event_id) AS BIGINT) AS value FROM events")
q("q_group_first_last", "$.events.group_shape(user_id, {a: @.first().event_id, z: @.last().event_id, kinds: @.map(event_type).unique().count()})",
  "SELECT CAST(user_id AS VARCHAR) AS key, min(event_id) AS a, max(event_id) AS z, count(DISTINCT event_type) AS kinds FROM events GROUP BY user_id")
q("q_group_rolling", "$.events.group_shape(user_id, {r: @.map(event_id).rolling_max(3).last()})", "SELECT CAST(user_id AS VARCHAR) AS key, CASE WHEN count(*) >= 3 THEN CAST(max(event_id) AS DOUBLE) END AS r FROM events GROUP BY user_id")

# analytics
for _f, _sql in (("sum", "sum"), ("avg", "avg"), ("min", "min"), ("max", "max")):
    q(f"q_rolling_{_f}", f"$.events.map(value).rolling_{_f}(5).enumerate().map({{i: index, v: value}})",
      f"SELECT i, CASE WHEN i >= 4 THEN round(v, 4) END AS v FROM (SELECT row_number() OVER (ORDER BY event_id) - 1 AS i, {_sql}(value) OVER (ORDER BY event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS v FROM events)", {"v": 4})
for _f, _sql in (("lag(2)", "lag(value, 2) OVER (ORDER BY event_id)"), ("lead(1)", "lead(value) OVER (ORDER BY event_id)"),
                 ("diff_window()", "value - lag(value) OVER (ORDER BY event_id)"),
                 ("pct_change()", "CASE WHEN lag(value) OVER (ORDER BY event_id) <> 0 THEN (value - lag(value) OVER (ORDER BY event_id)) / lag(value) OVER (ORDER BY event_id) END"),
                 ("cummax()", "max(value) OVER (ORDER BY event_id)"), ("cummin()", "min(value) OVER (ORDER BY event_id)"),
                 ("zscore()", "(value - avg(value) OVER ()) / stddev_pop(value) OVER ()")):
    q(f"q_{_f.split('(')[0]}", f"$.events.map(value).{_f}.enumerate().map({{i: index, v: value}})",
      f"SELECT row_number() OVER (ORDER BY event_id) - 1 AS i, round({_sql}, 4) AS v FROM events", {"v": 4})

# joins
q("q_equi_join", "$.orders.equi_join($.customer, o_custkey, c_custkey).map({o_orderkey, c_name})", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
q("q_equi_join_mixed", "$.customer.equi_join($.nation.map({k: n_nationkey.to_string(), n_name}), c_nationkey, k).map({c_custkey, n_name})", "SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
q("q_three_way", "$.orders.equi_join($.customer, o_custkey, c_custkey).equi_join($.nation, c_nationkey, n_nationkey).group_shape(n_name, {n: @.count(), total: @.sum(o_totalprice)})",
  "SELECT n_name AS key, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1", {"total": 2})
q("q_lookup_join", "let idx = $.nation.index_by(n_nationkey) in $.customer.map({c_custkey, nation: idx[c_nationkey].n_name})", "SELECT c_custkey, n_name AS nation FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
q("q_correlated", "$.customer.map(c => {c_custkey, orders: $.orders.filter(o_custkey == c.c_custkey).count(), spent: $.orders.filter(o_custkey == c.c_custkey).sum(o_totalprice), first: $.orders.filter(o_custkey == c.c_custkey).first().o_orderkey})",
  "SELECT c_custkey, count(o_orderkey) AS orders, round(coalesce(sum(o_totalprice), 0), 2) AS spent, min(o_orderkey) AS first FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey", {"spent": 2})
q("q_theta_join", "$.region.flat_map(r => $.nation.filter(n_regionkey > r.r_regionkey).map(n_name))", "SELECT n_name AS value FROM region JOIN nation ON n_regionkey > r_regionkey")
q("q_theta_count", "$.supplier.map(s => {s_suppkey, poorer: $.customer.filter(c_acctbal < s.s_acctbal).count(), next: $.customer.filter(c_acctbal >= s.s_acctbal).min(c_acctbal), sum: $.customer.filter(s.s_acctbal > c_acctbal).sum(c_custkey)})",
  "SELECT s_suppkey, (SELECT count(*) FROM customer WHERE c_acctbal < s_acctbal) AS poorer, (SELECT min(c_acctbal) FROM customer WHERE c_acctbal >= s_acctbal) AS next, (SELECT CAST(coalesce(sum(c_custkey), 0) AS BIGINT) FROM customer WHERE c_acctbal < s_acctbal) AS sum FROM supplier")
q("q_theta_residual", "$.customer.map(c => {c_custkey, big: $.orders.filter(o_custkey == c.c_custkey and o_totalprice > c.c_acctbal * 10).count()})",
  "SELECT c_custkey, count(o_orderkey) AS big FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > c_acctbal * 10 GROUP BY c_custkey")
q("q_theta_between", "$.part.filter(p_partkey <= 20).map(p => {p_partkey, n: $.supplier.filter(s_acctbal > p.p_size * 10 and s_acctbal < p.p_size * 200).count()})",
  "SELECT p_partkey, (SELECT count(*) FROM supplier WHERE s_acctbal > p_size * 10 AND s_acctbal < p_size * 200) AS n FROM part WHERE p_partkey <= 20")

# descending orders with nulls, and of text
_DEBT = "$.customer.map({c_custkey, c_nationkey, b: c_acctbal if c_acctbal > 0 else null}).sort(-b, c_custkey)"
_DEBT_SQL = "(SELECT c_custkey, c_nationkey, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS b FROM customer)"
q("q_desc_unique_by", _DEBT + ".unique_by(c_nationkey).map(c_custkey)", f"SELECT c_custkey AS value FROM {_DEBT_SQL} QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY b DESC NULLS LAST, c_custkey) = 1")
q("q_desc_take_while", _DEBT + ".take_while(b > 5000).map(c_custkey)", f"SELECT c_custkey AS value FROM {_DEBT_SQL} WHERE b > 5000")
q("q_desc_drop_while", _DEBT + ".drop_while(b > 0).map(c_custkey)", f"SELECT c_custkey AS value FROM {_DEBT_SQL} WHERE b IS NULL")
q("q_desc_find_index", _DEBT + ".find_index(c_custkey == 7)", f"SELECT i AS value FROM (SELECT c_custkey, row_number() OVER (ORDER BY b DESC NULLS LAST, c_custkey) - 1 AS i FROM {_DEBT_SQL}) WHERE c_custkey = 7")
q("q_desc_group_ends", _DEBT + ".group_shape(c_nationkey, {a: @.first().c_custkey, z: @.last().c_custkey})",
  f"SELECT CAST(c_nationkey AS VARCHAR) AS key, first(c_custkey ORDER BY b DESC NULLS LAST, c_custkey) AS a, last(c_custkey ORDER BY b DESC NULLS LAST, c_custkey) AS z FROM {_DEBT_SQL} GROUP BY c_nationkey")
q("q_desc_index_by", _DEBT + ".index_by(c_nationkey).transform_values(c_custkey)", f"SELECT CAST(c_nationkey AS VARCHAR) AS key, last(c_custkey ORDER BY b DESC NULLS LAST, c_custkey) AS value FROM {_DEBT_SQL} GROUP BY c_nationkey")
q("q_desc_enumerate", "$.customer.sort(-c_mktsegment, -c_name).enumerate().map({i: index, k: value.c_custkey})", "SELECT row_number() OVER (ORDER BY c_mktsegment DESC, c_name DESC) - 1 AS i, c_custkey AS k FROM customer")
q("q_desc_text_skip", "$.customer.sort(-c_name).skip(20).map(c_custkey)", "SELECT c_custkey AS value FROM customer ORDER BY c_name DESC OFFSET 20")
q("q_desc_text_unique_by", "$.customer.sort(-c_mktsegment, -c_name).unique_by(c_nationkey).map(c_custkey)",
  "SELECT c_custkey AS value FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment DESC, c_name DESC) = 1")
q("q_skip_lineitem", "$.lineitem.skip(100).map({l_orderkey, l_linenumber})", "SELECT l_orderkey, l_linenumber FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate OFFSET 100")

# forms of navigation, objects that leave out nulls
q("q_has_operator", "$.nation.filter(n_name has 'A').map(n_name)", "SELECT n_name AS value FROM nation WHERE contains(n_name, 'A')")
q("q_optional_field", "$.nation.map({a: @?.n_name, b: (@?.nope ?? 'none')})", "SELECT n_name AS a, 'none' AS b FROM nation")
q("q_dynamic_index", "$.embeddings.map(embedding[vec_id % 4])", "SELECT embedding[vec_id % 4 + 1] AS value FROM embeddings")
q("q_descendant_first", "$.orders..o_orderkey.first()", "SELECT min(o_orderkey) AS value FROM orders")
q("q_deep_spread", "$.region.map({...**{a: {n: r_name}}, ...**{a: {k: r_regionkey}}}).map({n: a.n, k: a.k})", "SELECT r_name AS n, r_regionkey AS k FROM region")
q("q_drop_nulls_len", "$.customer.map({c_custkey, owes?: c_acctbal if c_acctbal < 0 else null}).map({k: c_custkey, n: @.len()})", "SELECT c_custkey AS k, CASE WHEN c_acctbal < 0 THEN 2 ELSE 1 END::BIGINT AS n FROM customer")
q("q_drop_nulls_json", "$.nation.map({k: n_nationkey, first: n_name when n_regionkey == 0}.to_json())",
  "SELECT '{\"k\":' || n_nationkey || CASE WHEN n_regionkey = 0 THEN ',\"first\":\"' || n_name || '\"' ELSE '' END || '}' AS value FROM nation")
q("q_drop_nulls_keys", "$.supplier.map({s_suppkey, debt?: null, owes: 1 when s_acctbal < 0}.keys().join(','))", "SELECT CASE WHEN s_acctbal < 0 THEN 's_suppkey,owes' ELSE 's_suppkey' END AS value FROM supplier")
q("q_precedence", "$.part.filter(not p_size > 5 and p_size != 3 or p_size == 7).map({p_partkey, v: p_size + 2 * 3 - 1})", "SELECT p_partkey, p_size + 5 AS v FROM part WHERE NOT p_size > 5 AND p_size <> 3 OR p_size = 7")

# objects
_ONE = "SELECT n_nationkey, n_name, n_regionkey FROM nation"
q("q_keys", "$.nation.map({k: @.keys().join(',')})", "SELECT 'n_nationkey,n_name,n_regionkey' AS k FROM nation")
q("q_keys_of_groups", "$.orders.count_by(o_orderstatus).keys()", "SELECT DISTINCT o_orderstatus AS value FROM orders")
q("q_values", "$.nation.map({a: n_name, b: n_name.lower()}).map(@.values().join(','))", "SELECT n_name || ',' || lower(n_name) AS value FROM nation")
q("q_entries", "$.nation.map({a: n_name}).map(@.entries().flatten().join('='))", "SELECT 'a=' || n_name AS value FROM nation")
q("q_to_pairs", "$.orders.count_by(o_orderstatus).to_pairs()", "SELECT o_orderstatus AS key, count(*) AS val FROM orders GROUP BY 1")
q("q_from_pairs", "$.nation.map([n_regionkey.to_string(), n_name]).from_pairs()", "SELECT CAST(n_regionkey AS VARCHAR) AS key, arg_max(n_name, n_nationkey) AS value FROM nation GROUP BY n_regionkey")
q("q_invert", "$.nation.pivot(n_name, n_nationkey).invert()", "SELECT CAST(n_nationkey AS VARCHAR) AS key, n_name AS value FROM nation")
q("q_merge", "$.region.map({r_name, x: 1}).merge({x: 2, y: 3})", "SELECT r_name, 2::BIGINT AS x, 3::BIGINT AS y FROM region")
q("q_deep_merge", "$.region.map({o: {a: r_name, b: 1}}).deep_merge({o: {b: 2, c: 3}}).map({a: o.a, b: o.b, c: o.c})", "SELECT r_name AS a, 2::BIGINT AS b, 3::BIGINT AS c FROM region")
q("q_defaults", "$.region.map({r_name, x: null}).defaults({x: 7, r_name: 'no'})", "SELECT r_name, 7::BIGINT AS x FROM region")
q("q_has", "$.nation.count(@.has('n_name'))", "SELECT count(*) AS value FROM nation")
q("q_missing", "$.nation.count(@.missing('n_name.x'))", "SELECT count(*) AS value FROM nation")
q("q_or", "$.orders.map((o_orderkey if o_orderkey % 2 == 0 else null).or(-1))", "SELECT CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey ELSE -1 END AS value FROM orders")
q("q_set", "$.region.map(r_name.set('x'))", "SELECT 'x' AS value FROM region")
q("q_update", "$.region.map(r_regionkey.update(@ + 1) as int)", "SELECT CAST(r_regionkey + 1 AS BIGINT) AS value FROM region")
q("q_transform_keys", "$.orders.count_by(o_orderstatus).transform_keys(@.lower())", "SELECT lower(o_orderstatus) AS key, count(*) AS value FROM orders GROUP BY 1")
q("q_transform_values", "$.orders.count_by(o_orderstatus).transform_values(@ * 2)", "SELECT o_orderstatus AS key, count(*) * 2 AS value FROM orders GROUP BY 1")
q("q_filter_keys", "$.orders.count_by(o_orderstatus).filter_keys(@ != 'F')", "SELECT o_orderstatus AS key, count(*) AS value FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1")
q("q_filter_values", "$.orders.count_by(o_custkey).filter_values(@ > 14)", "SELECT CAST(o_custkey AS VARCHAR) AS key, count(*) AS value FROM orders GROUP BY o_custkey HAVING count(*) > 14")

# paths and trees
_NEST = "$.nation.map({id: n_nationkey as int, at: {name: n_name, tags: [n_name, 'x']}})"
q("q_get_path", _NEST + ".map(@.get_path('at.tags[1]'))", "SELECT 'x' AS value FROM nation")
q("q_has_path", _NEST + ".count(@.has_path('at.name'))", "SELECT count(*) AS value FROM nation")
q("q_set_path", _NEST + ".set_path('at.name', 'z').map({id, n: at.name})", "SELECT CAST(n_nationkey AS BIGINT) AS id, 'z' AS n FROM nation")
q("q_del_path", _NEST + ".del_path('at.tags').map(@.to_json())", "SELECT '{\"id\":' || n_nationkey || ',\"at\":{\"name\":\"' || n_name || '\"}}' AS value FROM nation")
q("q_del_paths", _NEST + ".del_paths('at.tags', 'id').map(@.to_json())", "SELECT '{\"at\":{\"name\":\"' || n_name || '\"}}' AS value FROM nation")
q("q_flatten_keys", _NEST + ".map({id, at: {name: at.name}}).flatten_keys()", "SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS \"at.name\" FROM nation")
q("q_unflatten_keys", _NEST + ".map({'a.b': at.name, 'a.c': id}).unflatten_keys().map({b: a.b, c: a.c})", "SELECT n_name AS b, CAST(n_nationkey AS BIGINT) AS c FROM nation")
q("q_walk", _NEST + ".walk(try @ + 1 else @).map({id, n: at.name})", "SELECT CAST(n_nationkey + 1 AS BIGINT) AS id, n_name AS n FROM nation")
q("q_walk_pre", _NEST + ".walk_pre(@.lower() if @ kind string else @).map(at.tags.join(','))", "SELECT lower(n_name) || ',x' AS value FROM nation")
q("q_rec", "$.nation.map((n_nationkey as int).rec(@ if @ < 3 else @ - 1))", "SELECT CAST(least(n_nationkey, 2) AS BIGINT) AS value FROM nation")
q("q_trace_path", _NEST + ".trace_path(@ == 'x').map({path, value: value as string})", "SELECT '$.at.tags[1]' AS path, 'x' AS value FROM nation")
q("q_descendant", _NEST + "..name", "SELECT n_name AS value FROM nation")
q("q_descendant_tables", "$..c_name", "SELECT c_name AS value FROM customer")
q("q_deep_find", "$..find(@.c_acctbal < 0).map({c_custkey})", "SELECT c_custkey FROM customer WHERE c_acctbal < 0")
q("q_deep_shape", "$..shape({p_brand, p_size}).map(p_partkey)", "SELECT p_partkey AS value FROM part")
q("q_deep_like", "$..like({o_orderstatus: 'P', o_orderpriority: '5-LOW'}).map(o_orderkey)", "SELECT o_orderkey AS value FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority = '5-LOW'")

# strings
for _name, _expr, _sql in (
        ("upper", "p_name.upper()", "upper(p_name)"), ("lower", "p_name.lower()", "lower(p_name)"),
        ("capitalize", "p_name.capitalize()", "upper(p_name[1:1]) || lower(p_name[2:])"),
        ("title_case", "p_type.title_case()", "array_to_string(list_transform(string_split(lower(p_type), ' '), lambda x: upper(x[1:1]) || x[2:]), ' ')"),
        ("snake_case", "p_type.snake_case()", "replace(replace(replace(lower(p_type), ' ', '_'), '#', '#'), '-', '_')"),
        ("kebab_case", "p_type.kebab_case()", "replace(lower(p_type), ' ', '-')"),
        ("camel_case", "p_type.camel_case()", "lower(string_split(p_type, ' ')[1]) || array_to_string(list_transform(string_split(lower(p_type), ' ')[2:], lambda x: upper(x[1:1]) || x[2:]), '')"),
        ("pascal_case", "p_type.pascal_case()", "array_to_string(list_transform(string_split(lower(p_type), ' '), lambda x: upper(x[1:1]) || x[2:]), '')"),
        ("reverse_str", "p_name.reverse_str()", "reverse(p_name)"), ("reverse", "p_name.reverse()", "reverse(p_name)"),
        ("trim", "('  ' + p_name + ' ').trim()", "p_name"), ("trim_left", "('  ' + p_name + ' ').trim_left()", "p_name || ' '"), ("trim_right", "(' ' + p_name + '  ').trim_right()", "' ' || p_name"),
        ("words", "p_type.words().join('|')", "array_to_string(regexp_extract_all(p_type, '\\S+'), '|')"),
        ("chars", "p_brand.chars().join('.')", "array_to_string(string_split(p_brand, ''), '.')"), ("chars_of", "p_brand.chars_of().len()", "length(p_brand)"),
        ("bytes", "p_brand.bytes()[0]", "CAST(ascii(p_brand) AS BIGINT)"), ("byte_len", "p_name.byte_len()", "CAST(strlen(p_name) AS BIGINT)"),
        ("split", "p_type.split(' ').len()", "len(string_split(p_type, ' '))"), ("slice", "p_name.slice(1, -1)", "p_name[2:-2]"),
        ("replace", "p_name.replace('a', '*')", "regexp_replace(p_name, 'a', '*')"), ("replace_all", "p_name.replace_all('a', '*')", "replace(p_name, 'a', '*')"),
        ("starts_with", "p_brand.starts_with('Brand#1')", "starts_with(p_brand, 'Brand#1')"), ("ends_with", "p_brand.ends_with('3')", "ends_with(p_brand, '3')"),
        ("index_of", "p_name.index_of('a')", "CAST(instr(p_name, 'a') - 1 AS BIGINT)"),
        ("last_index_of", "p_name.last_index_of('a')", "CAST(CASE WHEN instr(p_name, 'a') = 0 THEN -1 ELSE length(p_name) - instr(reverse(p_name), 'a') END AS BIGINT)"),
        ("strip_prefix", "p_brand.strip_prefix('Brand#')", "p_brand[7:]"), ("strip_suffix", "p_brand.strip_suffix('3')", "CASE WHEN ends_with(p_brand, '3') THEN p_brand[:-2] ELSE p_brand END"),
        ("pad_left", "p_brand.pad_left(12, '.')", "repeat('.', 12 - length(p_brand)) || p_brand"), ("pad_right", "p_brand.pad_right(12)", "p_brand || repeat(' ', 12 - length(p_brand))"),
        ("center", "p_brand.center(13, '-')", "repeat('-', (13 - length(p_brand)) // 2) || p_brand || repeat('-', 13 - length(p_brand) - (13 - length(p_brand)) // 2)"),
        ("repeat", "p_brand.repeat(2)", "repeat(p_brand, 2)"), ("scan", "p_name.scan('a').len()", "CAST(length(p_name) - length(replace(p_name, 'a', '')) AS BIGINT)"),
        ("matches", "p_name.matches('ar')", "contains(p_name, 'ar')"), ("contains", "p_name.contains('ar')", "contains(p_name, 'ar')"),
        ("contains_any", "p_name.contains_any(['z', 'q'])", "contains(p_name, 'z') OR contains(p_name, 'q')"), ("contains_all", "p_name.contains_all(['a', 'r'])", "contains(p_name, 'a') AND contains(p_name, 'r')"),
        ("is_blank", "p_name.replace_all('a', '').is_blank()", "trim(replace(p_name, 'a', '')) = ''"), ("is_numeric", "p_brand.strip_prefix('Brand#').is_numeric()", "regexp_full_match(p_brand[7:], '[0-9]+')"),
        ("is_alpha", "p_type.is_alpha()", "regexp_full_match(p_type, '[A-Za-z]+')"), ("is_ascii", "p_name.is_ascii()", "true"),
        ("to_base64", "p_name.to_base64()", "to_base64(encode(p_name))"), ("from_base64", "p_name.to_base64().from_base64()", "p_name"),
        ("url_encode", "p_type.url_encode()", "url_encode(p_type)"), ("url_decode", "p_type.url_encode().url_decode()", "p_type"),
        ("html_escape", "('<' + p_type + '&').html_escape()", "'&lt;' || p_type || '&amp;'"), ("html_unescape", "('&lt;' + p_type + '&amp;').html_unescape()", "'<' || p_type || '&'"),
        ("re_match", "p_brand.re_match('#[1-3]')", "regexp_matches(p_brand, '#[1-3]')"), ("match_first", "p_brand.match_first('[0-9]')", "nullif(regexp_extract(p_brand, '[0-9]'), '')"),
        ("match_all", "p_brand.match_all('[0-9]').join(',')", "array_to_string(regexp_extract_all(p_brand, '[0-9]'), ',')"),
        ("captures", "p_brand.captures('([a-z]+)#([0-9])').join('|')", "regexp_extract(p_brand, '([a-z]+)#([0-9])') || '|' || regexp_extract(p_brand, '([a-z]+)#([0-9])', 1) || '|' || regexp_extract(p_brand, '([a-z]+)#([0-9])', 2)"),
        ("captures_all", "p_brand.captures_all('([0-9])').map(@[1]).join('|')", "array_to_string(regexp_extract_all(p_brand, '[0-9]'), '|')"),
        ("split_re", "p_type.split_re('[ #]').len()", "len(regexp_split_to_array(p_type, '[ #]'))"),
        ("replace_re", "p_brand.replace_re('([0-9])', '<$1>')", "regexp_replace(p_brand, '([0-9])', '<\\1>')"), ("replace_all_re", "p_brand.replace_all_re('([0-9])', '<$1>')", "regexp_replace(p_brand, '([0-9])', '<\\1>', 'g')"),
        ("fuzzy", "p_name ~= 'PART'", "contains(lower(p_name), 'part') OR contains('part', lower(p_name))"),
        ("fstring", "f\"{p_brand}: {p_retailprice:.1f} [{p_size:05}] {p_type|lower}\"", "p_brand || ': ' || printf('%.1f', p_retailprice) || ' [' || lpad(CAST(p_size AS VARCHAR), 5, '0') || '] ' || lower(p_type)"),
        ("ceil", "p_retailprice.ceil()", "CAST(ceil(p_retailprice) AS BIGINT)"), ("floor", "p_retailprice.floor()", "CAST(floor(p_retailprice) AS BIGINT)"),
        ("round", "p_retailprice.round()", "CAST(round(p_retailprice) AS BIGINT)"), ("abs", "(p_retailprice - 1000).abs()", "abs(p_retailprice - 1000)"),
        ("parse_int", "p_brand.strip_prefix('Brand#').parse_int()", "CAST(p_brand[7:] AS BIGINT)"), ("parse_float", "(' ' + p_brand.strip_prefix('Brand#') + '.5').parse_float()", "CAST(p_brand[7:] || '.5' AS DOUBLE)"),
        ("parse_bool", "('yes' if p_size > 25 else 'off').parse_bool()", "p_size > 25"), ("to_number", "p_brand.strip_prefix('Brand#').to_number()", "CAST(p_brand[7:] AS DOUBLE)"),
        ("to_bool", "('true' if p_size > 25 else 'no').to_bool()", "CASE WHEN p_size > 25 THEN true END"), ("to_string", "p_size.to_string()", "CAST(p_size AS VARCHAR)"),
        ("to_json", "{s: p_size, b: p_brand}.to_json()", "'{\"s\":' || p_size || ',\"b\":\"' || p_brand || '\"}'"),
        ("type", "p_size.type() + p_name.type()", "'numberstring'"), ("kind", "p_size kind number and p_name is not null", "true"),
        ("cast", "(p_size as string) + (p_size as bool as string)", "CAST(p_size AS VARCHAR) || CASE WHEN p_size = 0 THEN 'false' ELSE 'true' END"),
        ("divide", "p_size / 4", "p_size / 4.0::DOUBLE"), ("modulo", "(p_size - 25) % 7 as int", "CAST((p_size - 25) % 7 AS BIGINT)"),
        ("ternary", "'big' if p_size > 40 else 'mid' if p_size > 20 else 'small'", "CASE WHEN p_size > 40 THEN 'big' WHEN p_size > 20 THEN 'mid' ELSE 'small' END"),
        ("try", "try p_size / (p_size - 25) else -1", "CASE WHEN p_size = 25 THEN -1 ELSE p_size / (p_size - 25)::DOUBLE END"),
        ("coalesce", "(null if p_size > 25 else p_brand) ?? p_type", "CASE WHEN p_size > 25 THEN p_type ELSE p_brand END"),
        ("logic", "not (p_size > 10 and p_size < 30) or p_brand == 'Brand#11'", "NOT (p_size > 10 AND p_size < 30) OR p_brand = 'Brand#11'"),
        ("unequal_kinds", "p_size == p_name", "false"), ("to_csv", "{p_size, p_name}.to_csv()", "CAST(p_size AS VARCHAR) || ',' || p_name"),
        ("to_tsv", "[p_brand, p_name].to_tsv()", "p_brand || chr(9) || p_name"), ("lines", "(p_name + '\\n' + p_brand).lines().len()", "CAST(1 AS BIGINT)"),
        ("indent", "p_brand.indent(3)", "'   ' || p_brand"), ("dedent", "p_brand.indent(3).dedent()", "p_brand"),
        ("from_json", "('{\"k\": ' + p_size.to_string() + '}').from_json().k as int", "CAST(p_size AS BIGINT)"),
        ("array_ops", "[p_size, 3, p_size, null].compact().unique().sort().join(',')", "CASE WHEN p_size = 3 THEN '3' WHEN p_size < 3 THEN p_size || ',3' ELSE '3,' || p_size END"),
        ("array_stats", "[p_size, 10, 20].sum() + [p_size, 10].max()", "CAST(p_size + 30 + greatest(p_size, 10) AS BIGINT)")):
    q(f"q_str_{_name}", f"$.part.map({{p_partkey, v: {_expr}}})", f"SELECT p_partkey, {_sql} AS v FROM part")
q("q_json_props", "$.events.map({event_id, k: props.from_json().k as int})", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
q("q_page_text", "$.pages.map({page_id, n: html.match_all('<p>').len(), host: url.split('/')[2]})", "SELECT page_id, len(regexp_extract_all(html, '<p>')) AS n, string_split(url, '/')[3] AS host FROM pages")
q("q_schema", "$.region.schema()", "SELECT '{\"type\":\"Array\",\"items\":{\"type\":\"Object\",\"required\":[\"r_regionkey\",\"r_name\"],\"fields\":{\"r_regionkey\":{\"type\":\"Int\"},\"r_name\":{\"type\":\"String\"}}}}' AS value")

# language forms
q("q_list_comp", "[o.o_orderkey for o in $.orders if o.o_totalprice > 200000]", "SELECT o_orderkey AS value FROM orders WHERE o_totalprice > 200000")
q("q_dict_comp", "{o.o_custkey: o.o_orderkey for o in $.orders if o.o_orderstatus == 'F'}", "SELECT CAST(o_custkey AS VARCHAR) AS key, max(o_orderkey) AS value FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey")
q("q_set_comp", "{p.p_type for p in $.part}", "SELECT DISTINCT p_type AS value FROM part")
q("q_two_fors", "[r.r_name + n.n_name for r in $.region for n in $.nation if n.n_regionkey == r.r_regionkey]", "SELECT r_name || n_name AS value FROM region JOIN nation ON n_regionkey = r_regionkey")
q("q_let", "let m = $.orders.avg(o_totalprice) in $.orders.filter(o_totalprice > m).count()", "SELECT count(*) AS value FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders)")
q("q_let_lambda", "let f = x => x * 2 in $.nation.map(f(n_nationkey) as int)", "SELECT CAST(n_nationkey * 2 AS BIGINT) AS value FROM nation")
q("q_pipe", "$.orders | filter(o_orderstatus == 'O') | map(o_orderkey) | max", "SELECT max(o_orderkey) AS value FROM orders WHERE o_orderstatus = 'O'")
q("q_bind", "$.nation.map(@ -> {n_name, ...rest} | n_name + ':' + rest.n_regionkey.to_string())", "SELECT n_name || ':' || n_regionkey AS value FROM nation")
q("q_spread", "$.region.map({...@, r_name: 'x', z: 1}).map({k: r_regionkey as int, r_name, z})", "SELECT CAST(r_regionkey AS BIGINT) AS k, 'x' AS r_name, 1::BIGINT AS z FROM region")
q("q_report", "{orders: $.orders.count(), spent: $.orders.sum(o_totalprice), biggest: $.orders.max_by(o_totalprice).o_orderkey}",
  "SELECT count(*) AS orders, round(sum(o_totalprice), 2) AS spent, arg_max(o_orderkey, (o_totalprice, -o_orderkey)) AS biggest FROM orders", {"spent": 2})

# writes
q("q_patch_set", "patch $ {region[*].r_name: 'x', region[*].z: 1}", "SELECT r_regionkey, 'x' AS r_name, 1::BIGINT AS z FROM region")
q("q_patch_when", "patch $ {part[*].p_size: 0 when $.region.count() == 5}", "SELECT p_partkey, p_name, p_brand, p_type, 0::BIGINT AS p_size, p_retailprice FROM part")
q("q_patch_wild_if", "patch $ {customer[* if c_acctbal < 0].c_acctbal: 0.0}", "SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_acctbal < 0 THEN 0 ELSE c_acctbal END AS c_acctbal, c_mktsegment FROM customer")
q("q_patch_delete", "patch $ {orders[* if o_orderstatus != 'P']: DELETE}", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders WHERE o_orderstatus = 'P'")
q("q_patch_index", "patch $ {nation[3].n_name: 'HERE'}", "SELECT n_nationkey, CASE WHEN n_nationkey = 3 THEN 'HERE' ELSE n_name END AS n_name, n_regionkey FROM nation")
q("q_chain_modify", "$.supplier[*].s_acctbal.modify(@ * 2)", "SELECT s_suppkey, s_name, s_nationkey, s_acctbal * 2 AS s_acctbal FROM supplier")
q("q_chain_unset", "$.supplier[*].unset(s_name)", "SELECT s_suppkey, s_nationkey, s_acctbal FROM supplier")
q("q_patch_nested", "$.nation.map({a: {b: n_name, c: 1}}).map(patch @ {a.c: 2, a.d: n_missing ?? 'd'}).map({b: a.b, c: a.c, d: a.d})", "SELECT n_name AS b, 2::BIGINT AS c, 'd' AS d FROM nation")


def engine(spark: SparkSession, sf_dir: str) -> Engine:
    """All tables of a folder; one is read only if a query names it."""
    e = Engine(spark)
    for name, order in ORDERS.items():
        e.table(name, spark.read.parquet(f"{sf_dir}/{name}.parquet"), order)
    return e


def used(text: str) -> dict[str, list[str]]:
    """Tables a query can reach: those it names, or all below ``$..``."""
    return ORDERS if "$.." in text else {n: o for n, o in ORDERS.items() if f"$.{n}" in text or f"{n}[" in text}


def run(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    text, _, digits = Q[name]
    e = Engine(spark)
    for table, order in used(text).items():
        e.table(table, spark.read.parquet(f"{sf_dir}/{table}.parquet"), order)
    df = e.query(text)
    return df.withColumns({n: F.round(column(n), d) for n, d in digits.items()}) if digits else df


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda s, d, name=name: run(name, s, d)) for name in Q}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql, _) in Q.items() if sql is not None}
