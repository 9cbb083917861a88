"""Readers on bytes that the tests write."""

import datetime
import json
import zipfile

from tidemark.sources import readers

D = datetime.date


def record(ticker="PETR4", day="20240416", kind="01", lot="02", market="010", cls="PN  EB  NM", close=2033, factor=10, name="AÇÃO"):
    money = f"{close:013d}"
    line = kind + day + lot + ticker.ljust(12) + market + name.ljust(12) + cls.ljust(10) + " " * 7 + money * 5 + " " * 31 + f"{700:018d}" + f"{123456:018d}" + " " * 22 + f"{factor:07d}"
    return line.ljust(245)


def test_price_records(spark, tmp_path):
    lines = ["00COTAHIST.2024", record(), record("VALE3", cls="ON", close=34, factor=1000), record("X", lot="96"), record("Y", market="020"), record("Z", cls="DRN"), record("Q", cls='ON "', close=1), "99COTAHIST"]
    (tmp_path / "p.txt").write_bytes("\r\n".join(lines).encode("latin-1"))
    got = {r.ticker: r for r in readers.read_prices(spark, str(tmp_path / "p.txt")).collect()}
    assert set(got) == {"PETR4", "VALE3", "Q"}
    p = got["PETR4"]
    assert (p.trade_date, p.ex_suffix, p.factor, p.close, p.quantity, p.volume, p.name) == (D(2024, 4, 16), "EB", 10, 2.033, 700, 1234.56, "AÇÃO")
    assert got["VALE3"].close == 0.00034 and got["VALE3"].ex_suffix is None
    assert {r.ticker for r in readers.read_prices(spark, str(tmp_path / "p.txt"), equity_only=False).collect()} == {"PETR4", "VALE3", "Z", "Q"}
    with zipfile.ZipFile(tmp_path / "p.zip", "w") as z:
        z.write(tmp_path / "p.txt", "COTAHIST.TXT")
    assert sorted(readers.read_price_archives(spark, str(tmp_path / "p.zip")).collect()) == sorted(got.values())


def test_filings_line_items_and_registry(spark, tmp_path):
    (tmp_path / "f.csv").write_bytes('LINK_DOC;CNPJ_CIA;DT_REFER;VERSAO;DENOM_CIA;CD_CVM;CATEG_DOC;ID_DOC;DT_RECEB\nhttp://x; 1 ;2015-12-31;2;AÇÚCAR "S.A.;9;DFP;77;2016-03-28\n'.encode("latin-1"))
    f = readers.read_filings(spark, str(tmp_path / "f.csv")).first()
    assert (f.company, f.period, f.version, f["name"], f.received) == ("1", D(2015, 12, 31), 2, 'AÇÚCAR "S.A.', D(2016, 3, 28))
    (tmp_path / "i.csv").write_bytes("CNPJ_CIA;DT_REFER;VERSAO;ORDEM_EXERC;CD_CONTA;DS_CONTA;VL_CONTA\n1;2015-12-31;1;ÚLTIMO;3.01;Receita;12.5\n2;2015-12-31;1;PENÚLTIMO;3.01;Receita;bad\n".encode("latin-1"))
    assert [(r.company, r.order, r.amount) for r in readers.read_line_items(spark, str(tmp_path / "i.csv"), ["1"]).collect()] == [("1", "ÚLTIMO", 12.5)]
    assert readers.read_line_items(spark, str(tmp_path / "i.csv")).filter("amount IS NULL").count() == 1
    for year, rows in ((2010, "1;PETR4;Petróleo\n2;;Antiga S.A.\n"), (2011, "1;PETR3;Petróleo Novo\n;XXXX3;Nada\n1;PETR4;Petróleo\n")):
        (tmp_path / f"r{year}.csv").write_bytes(("CNPJ_Companhia;Codigo_Negociacao;Nome_Empresarial\n" + rows).encode("latin-1"))
    r = readers.read_registry(spark, [str(tmp_path / "r2010.csv"), str(tmp_path / "r2011.csv")])
    assert sorted(map(tuple, r["tickers"].collect())) == [("PETR3", "1"), ("PETR4", "1")] and [tuple(x) for x in r["roots"].collect()] == [("PETR", "1")]
    assert sorted(map(tuple, r["names"].collect())) == [("1", "PETROLEO"), ("1", "PETROLEO NOVO"), ("2", "ANTIGA S A")]


def test_sector_snapshot(spark, tmp_path):
    snapshot = {"A": {"codeCVM": "1", "raw": {"cnpj": "33000167000101", "codeCVM": "9512", "industryClassification": "Oil / Gas / Wells"}}, "B": {"codeCVM": "2", "raw": {}}, "C": {"codeCVM": "3", "raw": {"cnpj": "", "industryClassification": "a / b / c"}}}
    (tmp_path / "s.json").write_text(json.dumps(snapshot))
    got = {r.code: (r.company, r.sector, r.segment, r.covered) for r in readers.read_sectors(spark, str(tmp_path / "s.json")).collect()}
    assert got == {"9512": ("33.000.167/0001-01", "Oil", "Wells", True), "2": (None, None, None, False), "3": ("", "a", "c", False)}


def test_messages(spark):
    df = lambda *xs: spark.createDataFrame([(json.dumps(x) if not isinstance(x, str) else x,) for x in xs], "value string")
    k = {"s": "BTC", "t": 1, "T": 2, "i": "1m", "o": "1.5", "h": "2", "l": "1", "c": "1.7", "v": "9", "x": True}
    got = readers.decode_klines(df({"e": "kline", "k": k}, {"stream": "z", "data": {"e": "kline", "k": {**k, "x": False}}}, {"e": "trade"}, "not json", {"data": None}))
    assert sorted((r.open_time, r.close_time, r.close, r.is_closed) for r in got.collect()) == [(1, 2, 1.7, False), (1, 2, 1.7, True)]
    a = {"a": 5, "p": "10.5", "q": "2", "f": 1, "l": 2, "T": 99, "m": True}
    trades = readers.decode_trades(df({"stream": "btcusdt@aggTrade", "data": a}, {"data": a}, {"stream": "x@y", "data": {"a": 1}}, {"stream": "x@y", "data": {**a, "p": "bad"}}))
    assert [tuple(r) for r in trades.collect()] == [("BTCUSDT", 5, 10.5, 2.0, 1, 2, 99, True)]
    d = readers.decode_depth(df({"stream": "btcusdt@depth20", "data": {"lastUpdateId": 7, "bids": [["1.5", "2"]], "asks": []}}, {"stream": "x"})).collect()
    assert len(d) == 1 and d[0].symbol == "BTCUSDT" and [tuple(x) for x in d[0].bids] == [(1.5, 2.0)] and d[0].asks == []
    s = readers.decode_catalog(df({"symbols": [{"symbol": "AB", "baseAsset": "A", "quoteAsset": "B", "status": "TRADING", "isSpotTradingAllowed": True, "more": 1}]})).first()
    assert tuple(s) == ("AB", "A", "B", "TRADING", True)
    assert tuple(readers.decode_tickers(df([{"symbol": "AB", "quoteVolume": "5.5", "lastPrice": "x"}])).first()) == ("AB", 5.5, None)


def test_reports_and_notes(spark, tmp_path):
    (tmp_path / "r1.json").write_text('{"run": "a", "final_equity": 5.0}')
    got = readers.read_reports(spark, str(tmp_path / "*.json"), "run string, final_equity double").collect()
    assert [(r.run, r.final_equity) for r in got] == [("a", 5.0)] and got[0].path.endswith("r1.json")
    (tmp_path / "n.md").write_text("# A title\n\n**Status:** open (draft)\n\ntext")
    (tmp_path / "m.md").write_text("no heading")
    notes = {r.path[-4:]: (r.status, r.title) for r in readers.read_notes(spark, str(tmp_path / "*.md")).collect()}
    assert notes == {"n.md": ("open (draft)", "A title"), "m.md": (None, None)}
