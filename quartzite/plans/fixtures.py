"""Two views over the provided tables, in SQL that Spark and DuckDB both read."""

DIRTY_CONTACTS = """
SELECT c_custkey AS rid,
  CASE c_custkey % 5 WHEN 0 THEN c_name || ' LLC' WHEN 1 THEN '  ' || c_name || ' Inc'
    WHEN 2 THEN c_name || '  Corp' WHEN 3 THEN '#' || c_name || '$' ELSE NULL END AS lgl_nm,
  CASE c_custkey % 3 WHEN 0 THEN 'dba ' || c_mktsegment WHEN 1 THEN '' ELSE NULL END AS dba_nm,
  CASE c_custkey % 7 WHEN 0 THEN CAST(2125550000 + c_custkey AS STRING)
    WHEN 1 THEN '212-555-' || lpad(CAST(c_custkey % 10000 AS STRING), 4, '0')
    WHEN 2 THEN '+1 212 555 ' || lpad(CAST(c_custkey % 10000 AS STRING), 4, '0')
    WHEN 3 THEN CAST(2125550000 + c_custkey AS STRING) || '.0'
    WHEN 4 THEN '555-' || lpad(CAST(c_custkey % 10000 AS STRING), 4, '0')
    WHEN 5 THEN '' ELSE NULL END AS phone,
  CASE c_custkey % 6 WHEN 0 THEN lpad(CAST(c_custkey % 500 AS STRING), 5, '0')
    WHEN 1 THEN CAST(1000 + c_custkey % 500 AS STRING) WHEN 2 THEN '10001-1234' WHEN 3 THEN '7702.0'
    WHEN 4 THEN 'ABC' ELSE NULL END AS zip,
  CASE c_custkey % 6 WHEN 0 THEN CAST(100000000 + c_custkey - c_custkey % 18 AS STRING)
    WHEN 1 THEN CAST(12345600 + c_custkey % 90 AS STRING) WHEN 2 THEN '12-3456789'
    WHEN 3 THEN '123-45-6789' WHEN 4 THEN CAST(200000000 + c_custkey AS STRING) || '.0' ELSE NULL END AS tin,
  CASE c_custkey % 5 WHEN 0 THEN 'Texas' WHEN 1 THEN 'tx' WHEN 2 THEN 'New York' WHEN 3 THEN 'ZZ' ELSE NULL END AS state,
  CASE c_custkey % 4 WHEN 0 THEN 'usa' WHEN 1 THEN 'United States' WHEN 2 THEN 'Canada' ELSE NULL END AS country,
  CASE c_custkey % 6 WHEN 0 THEN c_name || ' LLC|' || CAST(c_custkey % 40 AS STRING) || ' Main St|Austin|TX|78701|US'
    WHEN 1 THEN CAST(c_custkey % 40 AS STRING) || ' Oak Ave|Suite 5|Dallas|Texas|7520|USA'
    WHEN 2 THEN 'only street' WHEN 3 THEN 'Austin|TX|78701|US' WHEN 4 THEN '' ELSE NULL END AS business_address,
  CAST(c_custkey AS STRING) AS uid
FROM customer
"""

_APPLICATION = """
  SELECT o.o_orderkey + {shift} AS rid,
    CASE WHEN o.o_orderkey % 41 = 0 THEN NULL WHEN o.o_orderkey % 47 = 0 THEN ' nan' ELSE CAST(100000000 + o.o_custkey AS STRING) || CASE o.o_orderkey % 5 WHEN 1 THEN '.0' WHEN 2 THEN ' ' ELSE '' END END AS tin,
    CASE WHEN o.o_orderkey % 43 = 0 THEN NULL
         ELSE CAST(1000000000000 + o.o_custkey * 10 + o.o_orderkey % 3 AS STRING) || CASE o.o_orderkey % 7 WHEN 1 THEN '.0' ELSE '' END END AS mid,
    CASE WHEN o.o_orderkey % 53 = 0 THEN NULL WHEN o.o_orderkey % 6 = 1 THEN ' ' || lower(c.c_name) || '  ' ELSE upper(c.c_name) END AS legal_name,
    CASE WHEN o.o_orderkey % 9 = 1 THEN 'owner ' ELSE 'OWNER' END AS owner_first, CAST(o.o_custkey % 7 AS STRING) AS owner_last,
    CASE o.o_orderkey % 61 WHEN 0 THEN NULL WHEN 1 THEN lower(n.n_name) || ' ' ELSE n.n_name END AS state, CASE o.o_orderkey % 67 WHEN 0 THEN '  ' ELSE c.c_mktsegment END AS city,
    CASE WHEN o.o_orderkey % 59 = 0 THEN ' ' ELSE lpad(CAST(o.o_custkey % 500 AS STRING), 5, '0') END AS postal,
    CASE WHEN o.o_orderkey % 29 = 0 THEN NULL ELSE CAST(o.o_orderdate AS DATE) END AS open_date,
    CASE WHEN o.o_orderkey % 37 = 0 AND o.o_custkey % 4 = 0 THEN 1 ELSE 0 END AS is_fraud,
    CASE WHEN o.o_orderkey % 37 = 0 AND o.o_custkey % 4 = 0 THEN 1 + o.o_custkey % 3 ELSE NULL END AS fraud_type,
    o.o_totalprice AS amount
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey
  {where}
"""

#: Every 101st order comes twice, the second time under another rid.
APPLICATIONS = _APPLICATION.format(shift=0, where="") + " UNION ALL " + _APPLICATION.format(shift=100000000, where="WHERE o.o_orderkey % 101 = 0")
