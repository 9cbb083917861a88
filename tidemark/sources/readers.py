"""Readers of files and decoders of messages. Schemas are explicit; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text

LATIN = "ISO-8859-1"
#: Fields of a price record, first place (from 1) and width.
PRICE_FIELDS = {
    "kind": (1, 2), "date": (3, 8), "lot": (11, 2), "ticker": (13, 12), "market": (25, 3), "name": (28, 12), "class": (40, 10), "open": (57, 13), "high": (70, 13), "low": (83, 13),
    "avg": (96, 13), "close": (109, 13), "quantity": (153, 18), "volume": (171, 18), "factor": (211, 7),
}


def _lines(spark: SparkSession, paths: str | list[str], encoding: str = LATIN) -> DataFrame:
    """Whole lines as one column; the text source ignores encodings, the CSV source doesn't."""
    return spark.read.csv(paths, schema="line string", sep="\x01", quote="", escape="", encoding=encoding, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def _number(c: Column) -> Column:
    return F.trim(c).try_cast("bigint")


def parse_prices(lines: DataFrame, equity_only: bool = True) -> DataFrame:
    """Daily prices from fixed-width records in a column line: spot rows of the standard lot, of equity classes if asked.

    Prices have two implied decimals and are divided by the quotation factor. Other records, headers and trailers go.
    """
    at = {k: F.substring("line", *v) for k, v in PRICE_FIELDS.items()}
    spot = (at["kind"] == "01") & (at["lot"] == "02") & (at["market"] == "010")
    rows = lines.filter(spot & text.is_equity_class(at["class"]) if equity_only else spot)
    factor = _number(at["factor"])
    price = lambda k: text.scaled_price(_number(at[k]), factor).alias(k)
    return rows.select(
        F.trim(at["ticker"]).alias("ticker"), F.try_to_date(at["date"], "yyyyMMdd").alias("trade_date"), F.trim(at["name"]).alias("name"), F.rtrim(at["class"]).alias("class"),
        text.ex_suffix(at["class"]).alias("ex_suffix"), factor.cast("int").alias("factor"), *[price(k) for k in ("open", "high", "low", "avg", "close")],
        _number(at["quantity"]).alias("quantity"), (_number(at["volume"]) / 100).alias("volume"),
    )


def read_prices(spark: SparkSession, paths: str | list[str], equity_only: bool = True) -> DataFrame:
    return parse_prices(_lines(spark, paths), equity_only)


def read_price_archives(spark: SparkSession, paths: str | list[str], equity_only: bool = True) -> DataFrame:
    """The same from ZIP archives of such files; a task unpacks an archive line by line."""

    def unpack(batches):
        import io
        import zipfile

        import pandas as pd

        for batch in batches:
            for content in batch["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for name in z.namelist():
                        with z.open(name) as f:
                            part = []
                            for line in io.TextIOWrapper(f, LATIN, newline="\n"):
                                part.append(line.rstrip("\r\n"))
                                if len(part) == 10_000:
                                    yield pd.DataFrame({"line": part})
                                    part = []
                            yield pd.DataFrame({"line": part})

    files = spark.read.format("binaryFile").load(paths).select("content")
    return parse_prices(files.mapInPandas(unpack, "line string"), equity_only)


def _table(spark: SparkSession, paths: str | list[str], columns: dict[str, str]) -> DataFrame:
    """A latin-1 table between semicolons with a header; the named columns, whatever their order, trimmed and renamed."""
    rows = spark.read.csv(paths, header=True, sep=";", encoding=LATIN, quote="", inferSchema=False)
    return rows.select(*[F.trim(F.col(f"`{c}`")).alias(n) for c, n in columns.items()])


#: Columns of the filing index, of line items and of the security registry.
FILING_COLUMNS = {"CNPJ_CIA": "company", "DT_REFER": "period", "VERSAO": "version", "CATEG_DOC": "category", "DENOM_CIA": "name", "CD_CVM": "code", "ID_DOC": "filing_id", "DT_RECEB": "received", "LINK_DOC": "link"}
ITEM_COLUMNS = {"CNPJ_CIA": "company", "DT_REFER": "period", "VERSAO": "version", "ORDEM_EXERC": "order", "CD_CONTA": "account", "DS_CONTA": "description", "VL_CONTA": "amount"}
REGISTRY_COLUMNS = {"CNPJ_Companhia": "company", "Codigo_Negociacao": "ticker", "Nome_Empresarial": "name"}


def read_filings(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """The index of filings: company, period, version, category, name, code, filing_id, received, link."""
    rows = _table(spark, paths, FILING_COLUMNS)
    return rows.withColumns({"period": F.col("period").try_cast("date"), "received": F.col("received").try_cast("date"), "version": F.col("version").try_cast("int")})


def read_line_items(spark: SparkSession, paths: str | list[str], companies: list[str] | None = None) -> DataFrame:
    """Line items of the given companies, or of all."""
    rows = _table(spark, paths, ITEM_COLUMNS)
    rows = rows if companies is None else rows.filter(F.col("company").isin(*companies))
    return rows.withColumns({"period": F.col("period").try_cast("date"), "version": F.col("version").try_cast("int"), "amount": F.col("amount").try_cast("double")})


def read_registry(spark: SparkSession, paths: str | list[str]) -> dict[str, DataFrame]:
    """The registry of all years: tickers (ticker, company), roots (root, company), names (company, name), each distinct."""
    rows = _table(spark, paths, REGISTRY_COLUMNS).filter("company != ''")
    listed = rows.filter("ticker != ''")
    return {
        "tickers": listed.select("ticker", "company").distinct(), "roots": listed.select(F.substring("ticker", 1, 4).alias("root"), "company").distinct(),
        "names": rows.filter("name != ''").select("company", text.plain_name(F.col("name")).alias("name")).distinct(),
    }


def parse_sectors(entries: DataFrame) -> DataFrame:
    """company, code, sector, subsector, segment, covered from (cnpj, code, classification); rows without one stay, uncovered."""
    level = text.three_levels(F.col("classification"))
    covered = (F.coalesce("cnpj", F.lit("")) != "") & level.isNotNull()
    return entries.select(text.company_id(F.col("cnpj")).alias("company"), "code", level.alias("x"), covered.alias("covered")).select("company", "code", "x.*", "covered")


def read_sectors(spark: SparkSession, path: str) -> DataFrame:
    """A snapshot: one JSON object of entries by ticker, each with its payload under raw, which may be empty."""
    schema = "map<string, struct<codeCVM: string, raw: struct<cnpj: string, codeCVM: string, industryClassification: string>>>"
    entries = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", schema)).alias("ticker", "e"))
    return parse_sectors(entries.select(F.col("e.raw.cnpj").alias("cnpj"), F.coalesce("e.raw.codeCVM", "e.codeCVM").alias("code"), F.col("e.raw.industryClassification").alias("classification")))


def _double(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).try_cast("double")


def decode_klines(messages: DataFrame) -> DataFrame:
    """Candles from stream messages in a column value, in an envelope with data or bare; other messages go."""
    fields = "map<string, string>"  # t and T are different keys, which a struct's fields couldn't be
    m = messages.select(F.from_json("value", fields).alias("m"))
    m = m.select(F.coalesce(F.from_json(F.col("m")["data"], fields), F.col("m")).alias("m")).filter(F.col("m")["e"] == "kline")
    k = m.select(F.from_json(F.col("m")["k"], fields).alias("k")).filter(F.col("k")["s"].isNotNull())
    at = lambda a, kind: F.col("k")[a].try_cast(kind)
    return k.select(
        F.col("k")["s"].alias("symbol"), at("t", "bigint").alias("open_time"), at("T", "bigint").alias("close_time"), F.col("k")["i"].alias("interval"),
        *[at(a, "double").alias(n) for a, n in zip("ohlcv", ("open", "high", "low", "close", "volume"))], F.coalesce(at("x", "boolean"), F.lit(False)).alias("is_closed"),
    )


def decode_kline_rows(rows: DataFrame, interval: str) -> DataFrame:
    """Closed candles from rows (symbol, value) with value a JSON array: open time, prices, volume, close time."""
    a = F.from_json("value", "array<string>")
    at = lambda k: F.get("a", F.lit(k))
    return rows.select("symbol", a.alias("a")).filter(F.size("a") >= 7).select(
        "symbol", at(0).try_cast("bigint").alias("open_time"), at(6).try_cast("bigint").alias("close_time"), F.lit(interval).alias("interval"),
        *[_double(at(k)).alias(n) for k, n in enumerate(("open", "high", "low", "close", "volume"), 1)], F.lit(True).alias("is_closed"),
    )


def decode_trades(messages: DataFrame) -> DataFrame:
    """Aggregated trades from messages {stream, data}; the symbol is the stream's. Messages that lack a field go."""
    m = F.from_json("value", "stream string, data struct<a: bigint, p: string, q: string, f: bigint, l: bigint, T: bigint, m: boolean>")
    d = lambda k: F.col(f"m.data.{k}")
    return messages.select(m.alias("m")).filter("m.stream IS NOT NULL").select(
        F.upper(F.get(F.split("m.stream", "@"), F.lit(0))).alias("symbol"), d("a").alias("agg_trade_id"), _double(d("p")).alias("price"), _double(d("q")).alias("quantity"),
        d("f").alias("first_trade_id"), d("l").alias("last_trade_id"), d("T").alias("trade_time"), d("m").alias("is_buyer_maker"),
    ).dropna()


_LEVELS = "array<array<string>>"


def decode_depth(messages: DataFrame) -> DataFrame:
    """Order-book snapshots from messages {stream, data}; levels become (price, qty), best first."""
    m = F.from_json("value", f"stream string, data struct<lastUpdateId: bigint, bids: {_LEVELS}, asks: {_LEVELS}>")
    side = lambda c: F.transform(c, lambda x: F.struct(_double(F.get(x, F.lit(0))).alias("price"), _double(F.get(x, F.lit(1))).alias("qty")))
    return messages.select("*", m.alias("m")).filter("m.stream IS NOT NULL AND m.data IS NOT NULL").select(
        *[c for c in messages.columns if c != "value"], F.upper(F.get(F.split("m.stream", "@"), F.lit(0))).alias("symbol"),
        F.col("m.data.lastUpdateId").alias("last_update_id"), side("m.data.bids").alias("bids"), side("m.data.asks").alias("asks"),
    )


def decode_catalog(documents: DataFrame) -> DataFrame:
    """Tradable symbols from the catalog, one JSON document a row."""
    s = "struct<symbol: string, baseAsset: string, quoteAsset: string, status: string, isSpotTradingAllowed: boolean>"
    rows = documents.select(F.explode(F.from_json("value", f"symbols array<{s}>")["symbols"]).alias("s"))
    return rows.select("s.symbol", F.col("s.baseAsset").alias("base_asset"), F.col("s.quoteAsset").alias("quote_asset"), "s.status", F.coalesce("s.isSpotTradingAllowed", F.lit(False)).alias("is_spot_trading_allowed"))


def decode_tickers(documents: DataFrame) -> DataFrame:
    """24-hour tickers from a JSON array a row."""
    rows = documents.select(F.explode(F.from_json("value", "array<struct<symbol: string, quoteVolume: string, lastPrice: string>>")).alias("t"))
    return rows.select("t.symbol", _double("t.quoteVolume").alias("quote_volume"), _double("t.lastPrice").alias("last_price"))


def read_reports(spark: SparkSession, paths: str | list[str], schema: str) -> DataFrame:
    """Reports or metadata of all runs, one JSON document a file: path, modified and the schema's fields, newest first."""
    rows = spark.read.text(paths, wholetext=True).select(F.from_json("value", schema).alias("r"), "_metadata.file_path", "_metadata.file_modification_time")
    return rows.select(F.col("file_path").alias("path"), F.col("file_modification_time").alias("modified"), "r.*").orderBy(F.desc("modified"), "path")


def read_notes(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """path, status and title of Markdown documents, whole files."""
    rows = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), text.status_and_title(F.col("value")).alias("x"))
    return rows.select("path", "x.*")
