"""Queries over listed equities: price records, filings, identity and the universe with all its gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.operators import equities, identity, ingest
from tidemark.sources import adapters as src
from tidemark.sources import readers, scratch

from .catalog import _QUARTERS, CANDIDATES, MIN_VOLUME, months, quarters
from .registry import query

_CLASSES = "CASE p_size % 7 WHEN 0 THEN 'ON  EB NM' WHEN 1 THEN 'PNA EX' WHEN 2 THEN 'UNT' WHEN 3 THEN 'DRN ED' WHEN 4 THEN 'PN N2' WHEN 5 THEN 'ON ES' ELSE '' END"


def price_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily prices as fixed-width records of 245 characters, with records among them that aren't spot or equity."""
    cents = lambda c: F.lpad(F.floor(F.col(c) * 100).cast("string"), 13, "0")
    p = src.daily_prices(spark, sf_dir).withColumn("day", F.day("trade_date"))
    return p.select(F.concat(
        F.when(F.col("day") == 31, "00").otherwise("01"), F.date_format("trade_date", "yyyyMMdd"), F.when(F.col("day") == 30, "96").otherwise("02"), F.rpad("ticker", 12, " "), F.lit("010"),
        F.rpad(F.concat(F.lit("CIA "), "root"), 12, " "), F.rpad(F.concat(F.when(F.col("day") == 29, "DRN").otherwise("ON"), F.lit("  "), F.coalesce("ex_suffix", F.lit("NM"))), 10, " "), F.lit(" " * 7),
        *[cents("close")] * 5, F.lit(" " * 31), F.lpad(F.col("day").cast("string"), 18, "0"), F.lpad(F.floor(F.col("volume") * 100).cast("string"), 18, "0"), F.lit(" " * 22), F.lit("0000010"), F.lit(" " * 28),
    ).alias("line"))


@query(f"""WITH {src.PRICES} SELECT ticker, trade_date, 'CIA ' || root AS name, CASE WHEN ex_suffix IS NULL THEN 'ON  NM' ELSE 'ON  ' || ex_suffix END AS class, ex_suffix, 10 AS factor,
    floor(close * 100)::BIGINT / 100 / 10 AS close, day(trade_date)::BIGINT AS quantity, floor(volume * 100)::BIGINT / 100 AS volume FROM prices WHERE day(trade_date) < 29""")
def s1_price_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.parse_prices(price_lines(spark, sf_dir)).drop("open", "high", "low", "avg")


@query(f"""WITH c AS (SELECT p_partkey, {_CLASSES} AS c FROM part), t AS (SELECT *, regexp_split_to_array(trim(c), '\\s+') AS t FROM c)
    SELECT p_partkey, regexp_matches(t[1], '^(ON|PN|PR|OR)') OR t[1] = 'UNT' AS is_equity, CASE WHEN starts_with(t[2], 'E') THEN t[2] END AS ex_suffix,
    CASE WHEN NOT starts_with(t[2], 'E') OR t[2] IS NULL THEN NULL WHEN regexp_matches(t[2], '[BG]') THEN true WHEN t[2] = 'EX' THEN true ELSE false END AS is_level_break FROM t""")
def p1_class_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P1, P3 and P4 of class descriptions; the day's move is 0.4."""
    c = F.expr(_CLASSES)
    rows = src.table(spark, sf_dir, "part").select("p_partkey", text.is_equity_class(c).alias("is_equity"), text.ex_suffix(c).alias("ex_suffix"))
    return rows.withColumn("is_level_break", text.is_level_break(F.col("ex_suffix"), F.lit(0.4)))


@query("SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN NULL ELSE (p_retailprice * 100)::BIGINT / 100 / (p_size % 4) END AS price FROM part")
def p2_scaled_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.table(spark, sf_dir, "part").select("p_partkey", text.scaled_price(F.round(F.col("p_retailprice") * 100).cast("long"), F.col("p_size") % 4).alias("price"))


_ID = "CASE WHEN s_suppkey % 5 = 0 THEN ' ' || s_suppkey::VARCHAR ELSE lpad((s_suppkey * 7919)::VARCHAR, 14, '0') END"


@query(f"""WITH s AS (SELECT s_suppkey, trim({_ID}) AS d FROM supplier) SELECT s_suppkey, CASE WHEN length(d) = 14
    THEN d[1:2] || '.' || d[3:5] || '.' || d[6:8] || '/' || d[9:12] || '-' || d[13:14] ELSE d END AS company FROM s""")
def p5_company_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.when(F.col("s_suppkey") % 5 == 0, F.concat(F.lit(" "), F.col("s_suppkey").cast("string"))).otherwise(F.lpad((F.col("s_suppkey") * 7919).cast("string"), 14, "0"))
    return src.table(spark, sf_dir, "supplier").select("s_suppkey", text.company_id(raw).alias("company"))


_SECTOR = "CASE WHEN c_custkey % 7 = 0 THEN '' WHEN c_custkey % 11 = 0 THEN c_mktsegment || ' / ' ELSE 'Region ' || (c_nationkey % 5)::VARCHAR || ' / Nation ' || c_nationkey::VARCHAR || ' /  ' || c_mktsegment END"


@query(f"""WITH c AS (SELECT c_custkey, string_split({_SECTOR}, ' / ') AS p FROM customer), t AS (SELECT c_custkey, list_transform(p, lambda x: trim(x)) AS p FROM c)
    SELECT c_custkey AS code, lpad(c_custkey::VARCHAR, 14, '0')[1:2] || '.' || lpad(c_custkey::VARCHAR, 14, '0')[3:5] || '.' || lpad(c_custkey::VARCHAR, 14, '0')[6:8] || '/' || lpad(c_custkey::VARCHAR, 14, '0')[9:12] || '-' || lpad(c_custkey::VARCHAR, 14, '0')[13:14] AS company,
    CASE WHEN ok THEN p[1] END AS sector, CASE WHEN ok THEN p[2] END AS subsector, CASE WHEN ok THEN p[3] END AS segment, ok AS covered
    FROM (SELECT *, len(p) = 3 AND len(list_filter(p, lambda x: x = '')) = 0 AS ok FROM t)""")
def s5_sectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = src.table(spark, sf_dir, "customer")
    return readers.parse_sectors(c.select(F.lpad(F.col("c_custkey").cast("string"), 14, "0").alias("cnpj"), F.col("c_custkey").alias("code"), F.expr(_SECTOR.replace("::VARCHAR", "::string")).alias("classification")))


_PLAIN = "trim(regexp_replace(regexp_replace(upper(regexp_replace(strip_accents({0}), '[^\\x00-\\x7F]', '', 'g')), '[^A-Z0-9 ]', ' ', 'g'), ' +', ' ', 'g'))"
_GENERIC = "[" + ", ".join(f"'{x}'" for x in text.GENERIC_TOKENS) + "]"
_SIGNIFICANT = "list_filter(list_distinct(string_split({0}, ' ')), lambda w: length(w) >= 4 AND NOT list_contains(" + _GENERIC + ", w))"


@query(f"WITH n AS (SELECT doc_id, {_PLAIN.format('text')} AS name FROM documents) SELECT doc_id, length(name) AS n_chars, sha256(name) AS name_sha256 FROM n")
def p7_plain_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents as names."""
    names = src.table(spark, sf_dir, "documents").select("doc_id", text.plain_name(F.col("text")).alias("name"))
    return names.select("doc_id", F.length("name").cast("long").alias("n_chars"), F.sha2("name", 256).alias("name_sha256"))


@query(f"WITH n AS (SELECT doc_id, {_PLAIN.format('text')} AS name FROM documents), t AS (SELECT doc_id, list_sort({_SIGNIFICANT.format('name')}) AS t FROM n) SELECT doc_id, len(t) AS n_tokens, sha256(array_to_string(t, ' ')) AS tokens_sha256 FROM t")
def p8_significant_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = src.table(spark, sf_dir, "documents").select("doc_id", F.array_sort(text.significant_tokens(F.col("text"))).alias("t"))
    return tokens.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.sha2(F.array_join("t", " "), 256).alias("tokens_sha256"))


@query(f"""WITH {src.FILINGS}, k AS (SELECT year(received) AS year, row_number() OVER (PARTITION BY company, period, category ORDER BY received, filing_id) AS n,
    (company, period, category) IN (SELECT (company, period, category) FROM filings WHERE received < DATE '1997-01-01') AS old FROM filings WHERE received >= DATE '1996-07-01')
    SELECT year, count(*) FILTER (n = 1 AND NOT old) AS inserted, count(*) FILTER (n > 1 OR old) AS rejected_duplicate FROM k GROUP BY 1""")
def s10_append_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filings from mid-1996 on go into a table that holds those before 1997, one per company, period and category."""
    f = src.filings(spark, sf_dir)
    marked = ingest.append_new(f.filter("received >= DATE'1996-07-01'"), f.filter("received < DATE'1997-01-01'"), ["company", "period", "category"], ["received", "filing_id"])
    return ingest.ingest_counts(marked, F.year("received").alias("year"))


def line_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("filing_id"), F.col("l_linenumber").alias("account"), F.col("l_extendedprice").alias("amount"), (F.col("l_linestatus") == "F").alias("is_current")
    )


@query(f"""WITH {src.FILINGS}, d AS (SELECT max(decision_date) AS decision_date FROM (WITH {_QUARTERS} SELECT * FROM decisions) GROUP BY year(decision_date)),
    v AS (SELECT decision_date, company, period, category, max(version) AS version, arg_max(filing_id, version) AS filing_id FROM filings JOIN d ON received <= decision_date GROUP BY ALL)
    SELECT v.*, l_linenumber AS account, l_extendedprice AS amount FROM v JOIN lineitem ON l_orderkey = filing_id WHERE l_linestatus = 'F'""")
def j4_line_items_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As of the last quarter start of every year."""
    last = quarters(spark, sf_dir).groupBy(F.year("decision_date")).agg(F.max("decision_date").alias("decision_date")).select("decision_date")
    return equities.line_items_as_of(src.filings(spark, sf_dir), line_items(spark, sf_dir), last)


_TICKER = "'R' || lpad((s_suppkey // 2)::VARCHAR, 3, '0') || CASE WHEN s_suppkey % 2 = 0 THEN '3' ELSE '4' END"
_IDENTITY = f"""sup AS (SELECT s_suppkey AS k, {_TICKER} AS ticker, 'R' || lpad((s_suppkey // 2)::VARCHAR, 3, '0') AS root FROM supplier),
    asked AS (SELECT ticker, root, upper(p_name) AS name FROM sup JOIN part ON p_partkey = k),
    tickers AS (SELECT ticker, 'C' || (k // 3)::VARCHAR AS company FROM sup WHERE k % 4 = 0 UNION SELECT ticker, 'D' || k::VARCHAR FROM sup WHERE k % 12 = 0),
    roots AS (SELECT root, 'C' || (k // 5)::VARCHAR AS company FROM sup WHERE k % 5 < 2),
    names AS (SELECT 'N' || (p_partkey % 89)::VARCHAR AS company, upper(p_name) AS name FROM part WHERE p_partkey % 31 = 0 UNION SELECT 'N' || (p_partkey % 89)::VARCHAR, upper(p_name) || ' ' || p_type FROM part WHERE p_partkey % 37 = 0),
    c1 AS (SELECT ticker, min(company) AS c1 FROM tickers GROUP BY 1 HAVING count(DISTINCT company) = 1), c2 AS (SELECT root, min(company) AS c2 FROM roots GROUP BY 1 HAVING count(DISTINCT company) = 1),
    asked_tokens AS (SELECT ticker, unnest({_SIGNIFICANT.format('name')}) AS token, len({_SIGNIFICANT.format('name')}) AS n FROM asked),
    nt AS (SELECT DISTINCT company, name, unnest({_SIGNIFICANT.format('name')}) AS token FROM names),
    hit AS (SELECT ticker, company, name FROM asked_tokens JOIN nt USING (token) GROUP BY ticker, company, name HAVING count(*) = any_value(n)),
    c3 AS (SELECT ticker, min(company) AS c3 FROM hit GROUP BY 1 HAVING count(DISTINCT company) = 1),
    resolved AS (SELECT ticker, name, coalesce(c1, c2, c3) AS company, CASE WHEN c1 IS NOT NULL THEN 'listing' WHEN c2 IS NOT NULL THEN 'root' WHEN c3 IS NOT NULL THEN 'name' END AS source
        FROM asked LEFT JOIN c1 USING (ticker) LEFT JOIN c2 USING (root) LEFT JOIN c3 USING (ticker))"""


def registry_of(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Names asked for (ticker, name) from suppliers and parts, and a registry that knows some of them, some twice."""
    sup = src.table(spark, sf_dir, "supplier")
    root = F.concat(F.lit("R"), F.lpad(F.expr("s_suppkey div 2").cast("string"), 3, "0"))
    sup = sup.select(F.col("s_suppkey").alias("k"), F.concat(root, F.when(F.col("s_suppkey") % 2 == 0, "3").otherwise("4")).alias("ticker"), root.alias("root"))
    part = src.table(spark, sf_dir, "part")
    asked = sup.join(part, part.p_partkey == F.col("k")).select("ticker", F.upper("p_name").alias("name"))
    of = lambda letter, n: F.concat(F.lit(letter), n.cast("string")).alias("company")
    tickers = sup.filter("k % 4 = 0").select("ticker", of("C", F.expr("k div 3"))).union(sup.filter("k % 12 = 0").select("ticker", of("D", F.col("k")))).distinct()
    roots = sup.filter("k % 5 < 2").select("root", of("C", F.expr("k div 5"))).distinct()
    owner = of("N", F.col("p_partkey") % 89)
    names = part.filter("p_partkey % 31 = 0").select(owner, F.upper("p_name").alias("name")).union(part.filter("p_partkey % 37 = 0").select(owner, F.concat_ws(" ", F.upper("p_name"), "p_type").alias("name"))).distinct()
    return asked, {"tickers": tickers, "roots": roots, "names": names}


@query(f"WITH {_IDENTITY} SELECT * FROM resolved")
def j6_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listing, root, then containment of name tokens; each only if unambiguous."""
    return identity.resolve(*registry_of(spark, sf_dir))


#: A ticker that several names are asked for has its first one, as all are of one year.
_FIRST_NAMES = _IDENTITY.replace("SELECT ticker, root, upper(p_name) AS name FROM sup JOIN part ON p_partkey = k", "SELECT ticker, root, min(upper(p_name)) AS name FROM sup JOIN part ON p_partkey = k GROUP BY 1, 2")


@query(f"""WITH {src.PRICES}, {_FIRST_NAMES}, span AS (SELECT ticker, min(trade_date) AS valid_from, max(trade_date) AS last FROM prices GROUP BY 1)
    SELECT ticker, name, company, source, valid_from, CASE WHEN (SELECT max(last) FROM span) - last > 180 THEN last END AS valid_to, CASE WHEN company IS NULL THEN 'unresolved' END AS reason FROM resolved JOIN span USING (ticker)""")
def c2_ticker_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked, registry = registry_of(spark, sf_dir)
    return identity.ticker_map(asked.withColumn("year", F.lit(1995)), registry, src.daily_prices(spark, sf_dir)).drop("year")


@query("""WITH n AS (SELECT 'T' || (l_suppkey % 50)::VARCHAR AS ticker, 'name ' || l_returnflag || l_linestatus AS name, year(l_shipdate) AS year FROM lineitem WHERE year(l_shipdate) >= 1994 + l_suppkey % 7)
    SELECT ticker, arg_min(name, (year, name)) AS name, min(year) AS year FROM n GROUP BY 1""")
def u2_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = src.table(spark, sf_dir, "lineitem").filter("year(l_shipdate) >= 1994 + l_suppkey % 7")
    return identity.first_seen(line.select(F.concat(F.lit("T"), (F.col("l_suppkey") % 50).cast("string")).alias("ticker"), F.concat(F.lit("name "), "l_returnflag", "l_linestatus").alias("name"), F.year("l_shipdate").alias("year")))


_INTERVALS = """hk AS (SELECT ticker, min(trade_date) AS first, min(trade_date) + CAST((max(trade_date) - min(trade_date)) // 2 AS INTEGER) AS mid, count(*) AS hash_k FROM prices GROUP BY 1),
    iv AS (SELECT ticker, first AS valid_from, mid AS valid_to, 'A' || (hash_k % 40)::VARCHAR AS company FROM hk UNION ALL SELECT ticker, mid + 2, NULL, 'B' || (hash_k % 40)::VARCHAR FROM hk WHERE hash_k % 3 > 0)"""
_ASOF = "held AS (SELECT DISTINCT n.decision_date, n.ticker, arg_max(iv.company, (valid_from, iv.company)) OVER (PARTITION BY n.decision_date, n.ticker) AS company FROM n JOIN iv ON iv.ticker = n.ticker AND valid_from <= decision_date AND decision_date <= coalesce(valid_to, DATE '9999-12-31'))"


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two companies for most tickers, one after the other, with a day between them."""
    hk = src.daily_prices(spark, sf_dir).groupBy("ticker").agg(F.min("trade_date").alias("first"), F.max("trade_date").alias("last"), F.count(F.lit(1)).alias("k"))
    hk = hk.withColumn("mid", F.date_add("first", F.expr("cast(datediff(last, first) div 2 AS int)")))
    of = lambda letter: F.concat(F.lit(letter), (F.col("k") % 40).cast("string")).alias("company")
    one = hk.select("ticker", F.col("first").alias("valid_from"), F.col("mid").alias("valid_to"), of("A"))
    return one.union(hk.filter("k % 3 > 0").select("ticker", F.date_add("mid", 2), F.lit(None).cast("date"), of("B")))


@query(f"WITH {CANDIDATES}, {_INTERVALS}, {_ASOF} SELECT n.decision_date, n.ticker, company FROM n LEFT JOIN held USING (decision_date, ticker)")
def j5_company_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = equities.sessions_as_of(src.daily_prices(spark, sf_dir), months(spark, sf_dir)).select("decision_date", "ticker")
    return identity.company_as_of(asked, intervals(spark, sf_dir))


_FULL = f"""{CANDIDATES}, {_INTERVALS}, {_ASOF}, full_u AS (SELECT b.decision_date, b.ticker, company, CASE WHEN company[1] = 'A' THEN 'S' || (company[2:]::INT % 5)::VARCHAR END AS sector, median_volume, history,
    CASE WHEN median_volume < {MIN_VOLUME} THEN 'illiquid' WHEN best > 1 THEN 'less_liquid_class' WHEN company IS NULL THEN 'unresolved_identity' WHEN company[2:]::INT % 9 = 0 THEN 'judicial_recovery' WHEN history < 252 THEN 'short_history' END AS reason
    FROM b LEFT JOIN held USING (decision_date, ticker))"""


def _full(spark: SparkSession, sf_dir: str) -> DataFrame:
    iv = intervals(spark, sf_dir)
    companies = iv.select("company").distinct()
    number = F.substring("company", 2, 9).cast("int")
    recovery = companies.filter(number % 9 == 0)
    sectors = companies.filter("company LIKE 'A%'").select("company", F.concat(F.lit("S"), (number % 5).cast("string")).alias("sector"))
    return identity.full_universe(src.daily_prices(spark, sf_dir), months(spark, sf_dir), iv, recovery, sectors, MIN_VOLUME)


@query(f"WITH {_FULL} SELECT * FROM full_u")
def c1_full_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C1 with all gates (J5, J8, J14): candidates, liquidity, class, identity, recovery, history."""
    return _full(spark, sf_dir)


@query(f"WITH {_FULL} SELECT decision_date, count(*) AS candidates, count(*) FILTER (reason IS NULL) AS accepted, count(reason) AS excluded, 0 AS faults FROM full_u GROUP BY 1")
def u3_universe_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted and excluded tickers make up the candidates, each once; faults would be counted."""
    rows = _full(spark, sf_dir)
    wanted = equities.sessions_as_of(src.daily_prices(spark, sf_dir), months(spark, sf_dir))
    faults = identity.universe_faults(rows.filter("reason IS NULL"), rows.filter("reason IS NOT NULL"), wanted).groupBy("decision_date").agg(F.count(F.lit(1)).alias("f"))
    per = rows.groupBy("decision_date").agg(F.count(F.lit(1)).alias("candidates"), F.count_if(F.col("reason").isNull()).alias("accepted"), F.count("reason").alias("excluded"))
    return per.join(faults, "decision_date", "left").select("decision_date", "candidates", "accepted", "excluded", F.coalesce("f", F.lit(0)).cast("int").alias("faults"))


_NOTE = "CASE WHEN doc_id % 3 = 0 THEN '# Note ' || doc_id::VARCHAR || chr(10) || '**Status**: open ' || (doc_id % 5)::VARCHAR || chr(10) || text WHEN doc_id % 3 = 1 THEN 'status: done' || chr(10) || text ELSE '# Title only' || chr(10) || text END"


@query(f"""SELECT doc_id, nullif(trim(regexp_extract(t, '(?im)^[*_\\s]*status[*_\\s]*:[*_\\s]*([^\\n*]+)', 1)), '') AS status, nullif(trim(regexp_extract(t, '(?m)^#\\s+([^\\n]+)', 1)), '') AS title FROM (SELECT doc_id, {_NOTE} AS t FROM documents)""")
def s16_status_and_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents under a heading and a status line."""
    rows = src.table(spark, sf_dir, "documents").select("doc_id", text.status_and_title(F.expr(_NOTE.replace("::VARCHAR", "::string"))).alias("x"))
    return rows.select("doc_id", "x.*")




def _lines(rows: DataFrame, columns: dict[str, Column]) -> str:
    """rows rendered as a latin-1 table between semicolons with a header, in a new folder; values padded, columns in the
    order given."""
    where = scratch.path(rows.sparkSession, "lines")
    rows.select(*[c.cast("string").alias(n) for n, c in columns.items()]).write.option("header", True).option("sep", ";").option("encoding", readers.LATIN).option("quote", "").option("emptyValue", "").csv(where)
    return where


@query(f"""WITH {src.FILINGS} SELECT company::VARCHAR AS company, period, version::INT AS version, category, 'CIA ÁGUA ' || company AS name, (company * 7)::VARCHAR AS code, filing_id::VARCHAR AS filing_id,
    CASE WHEN filing_id % 11 > 0 THEN received END AS received FROM filings""")
def s2_filing_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filings as lines of the index, columns in another order, some days unreadable; read again."""
    f, c = src.filings(spark, sf_dir), F.col
    where = _lines(f, {
        "ID_DOC": c("filing_id"), "CNPJ_CIA": F.concat(F.lit(" "), c("company"), F.lit(" ")), "DT_REFER": c("period"), "VERSAO": c("version"), "EXTRA": F.lit("x"), "DENOM_CIA": F.concat(F.lit("CIA ÁGUA "), c("company")),
        "CD_CVM": c("company") * 7, "CATEG_DOC": c("category"), "DT_RECEB": F.when(c("filing_id") % 11 > 0, c("received").cast("string")).otherwise("00/00"), "LINK_DOC": F.lit("http://x"),
    })
    return readers.read_filings(spark, where).drop("link")


@query("""SELECT l_suppkey::VARCHAR AS company, make_date(year(l_shipdate), 12, 31) AS period, l_linenumber::INT AS version, CASE WHEN l_returnflag = 'R' THEN 'ÚLTIMO' ELSE 'PENÚLTIMO' END AS "order",
    l_orderkey::VARCHAR AS account, 'Conta ' || l_linestatus AS description, CASE WHEN l_orderkey % 13 > 0 THEN l_extendedprice END AS amount FROM lineitem""")
def s3_line_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3: line items as lines of a statement file, some amounts unreadable; read again."""
    li, c = src.table(spark, sf_dir, "lineitem"), F.col
    where = _lines(li, {
        "CNPJ_CIA": c("l_suppkey"), "DT_REFER": F.make_date(F.year("l_shipdate"), F.lit(12), F.lit(31)), "VERSAO": c("l_linenumber"), "ORDEM_EXERC": F.when(c("l_returnflag") == "R", "ÚLTIMO").otherwise("PENÚLTIMO"),
        "CD_CONTA": c("l_orderkey"), "DS_CONTA": F.concat(F.lit("Conta "), c("l_linestatus")), "VL_CONTA": F.when(c("l_orderkey") % 13 > 0, c("l_extendedprice").cast("string")).otherwise("n/d"),
    })
    return readers.read_line_items(spark, where)


@query("""WITH r AS (SELECT CASE WHEN c_custkey % 10 > 0 THEN c_nationkey::VARCHAR ELSE '' END AS company, CASE WHEN c_custkey % 3 > 0 THEN 'T' || lpad((c_custkey % 500)::VARCHAR, 4, '0') ELSE '' END AS ticker, c_mktsegment AS name FROM customer),
    k AS (SELECT * FROM r WHERE company != '') SELECT DISTINCT 'ticker' AS kind, ticker AS key, company FROM k WHERE ticker != '' UNION ALL SELECT DISTINCT 'root', ticker[1:4], company FROM k WHERE ticker != '' UNION ALL SELECT DISTINCT 'name', name, company FROM k""")
def s4_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The security registry as lines, some without a company or a ticker; read again as three lookups."""
    cu, c = src.table(spark, sf_dir, "customer"), F.col
    where = _lines(cu, {
        "Nome_Empresarial": c("c_mktsegment"), "Codigo_Negociacao": F.when(c("c_custkey") % 3 > 0, F.concat(F.lit("T"), F.lpad((c("c_custkey") % 500).cast("string"), 4, "0"))).otherwise(""),
        "CNPJ_Companhia": F.when(c("c_custkey") % 10 > 0, c("c_nationkey").cast("string")).otherwise(""),
    })
    found = readers.read_registry(spark, where)
    part = lambda kind, name, key: found[name].select(F.lit(kind).alias("kind"), F.col(key).alias("key"), "company")
    return part("ticker", "tickers", "ticker").unionByName(part("root", "roots", "root")).unionByName(part("name", "names", "name"))
