"""Upload files of any layout."""

import io
import zipfile
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from wayfold.sources import uploads as U


def xlsx(rows):
    """A workbook of one sheet: text as shared or inline strings, numbers as they are, empty cells left out."""
    shared, xml = [], []
    for r, row in enumerate(rows, 1):
        if not row:
            continue
        cells = []
        for c, v in enumerate(row):
            at = f"{chr(65 + c)}{r}"
            if isinstance(v, str) and c % 2:
                cells.append(f'<c r="{at}" t="inlineStr"><is><t>{v}</t></is></c>')
            elif isinstance(v, str):
                cells.append(f'<c r="{at}" t="s"><v>{len(shared)}</v></c>')
                shared.append(v)
            elif v is not None:
                cells.append(f'<c r="{at}"><v>{v}</v></c>')
        xml.append(f'<row r="{r}">{"".join(cells)}</row>')
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as book:
        book.writestr("xl/sharedStrings.xml", f"<sst {ns}>{''.join(f'<si><t>{s}</t></si>' for s in shared)}</sst>")
        book.writestr("xl/worksheets/sheet2.xml", f"<worksheet {ns}><sheetData/></worksheet>")
        book.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{''.join(xml)}</sheetData></worksheet>")
    return out.getvalue()


FILES = {
    "titles.csv": "Fleet report;;\n\nprinted 1 May;;\nVehicle No;GPS Date/Time;Latitude;Longitude;Speed limit;Speed\nMH12;03/04/2026 10:00;22.5;80,5;50;12.5\nMH12;13/04/2026 10:00:30;22.6 N;80.6;50;400\n;;;;;\nMH12;never;22.6;80.6;;\nMH12;14/04/2026;;80.6;;-3\n".encode("cp1252"),
    "months.csv": "ts,lat,lon\n04/13/2026 00:00,1,2\n03/04/2026 00:00,1,2\n2026-04-05T06:07:08Z,1,2\n1752732714,1,2\n20260405060708,1,2\n45678.5,1,2\n5,1,2\n".encode("utf-8-sig"),
    "umlaut.csv": "Größe,date,time,lat,lng\nß,5-Apr-2026,07:08,1.5,2.5\nx,2026/4/5,,1.5,2.5\n".encode("latin-1"),
    "wide.csv": "ts\tlat\tlon\n2026-04-05 06:07\t1\t2\n".encode("utf-16"),
    "sheet.xlsx": xlsx([["Trip sheet"], [], ["Date", "Time", "Lat", "Lon", "Trip No"], [46117, 0.5, 22.5, 80.5, 77], ["05/04/2026", "06:07:08", "22.6", 80.6, 77], [46117, None, None, 80.5, 77]]),
    "rows.json": b'{"x": 1, "fixes": [{"ts": 1752732714000, "lat": "1", "lon": 2, "imei": 9}, {"ts": null, "lat": 1, "lon": 2, "imei": 9}]}',
    "lines.json": b'{"ts": "2026-04-05 06:07:08", "lat": 1, "lon": 2, "speed": 2.5}\n{"ts": "2026-04-05", "lat": 1, "lon": 2, "speed": 3.5}\n',
    "other.csv": b"name,latitude\na,1\n",
    "blank.csv": b"\n \n",
    "broken.xlsx": b"PK\x03\x04 not a book",
    "header.csv": b"ts,lat,lon\n",
    "useless.csv": b"ts,lat,lon\nx,y,z\n",
}


@pytest.fixture(scope="module")
def read(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("uploads")
    for name, data in FILES.items():
        (folder / name).write_bytes(data)
    lines = U.read_lines(spark, str(folder)).withColumn("file", F.element_at(F.split("file", "/"), -1)).cache()
    fixes = U.fixes_of(lines).cache()
    report = {r.file: r for r in U.file_report(lines, fixes).collect()}
    rows = {}
    for r in sorted(fixes.collect(), key=lambda r: (r.file, r.row)):
        rows.setdefault(r.file, []).append(r)
    return report, rows


def test_how_files_were_read(read):
    report, _ = read
    assert set(report) == set(FILES)
    got = {f: (r.format, r.encoding, r.delimiter, r.header_row, r.rows) for f, r in report.items()}
    assert got["titles.csv"] == ("csv", "utf-8", ";", 4, 5) and got["months.csv"] == ("csv", "utf-8-sig", ",", 1, 7)
    assert got["umlaut.csv"][1:4] == ("cp1252", ",", 1) and got["wide.csv"][1:3] == ("utf-16", "\t")
    assert got["sheet.xlsx"][0] == "xlsx" and got["sheet.xlsx"][3:] == (3, 3) and got["rows.json"][0] == "json"
    assert (report["titles.csv"].fixes, report["titles.csv"].refused, report["titles.csv"].asset) == (2, 2, "MH12")
    assert (report["sheet.xlsx"].trip, report["rows.json"].asset) == ("77", "9")


def test_files_that_cannot_be_read(read):
    report, rows = read
    assert report["other.csv"].error == "no column for ts, lon; seen: name, latitude" and report["blank.csv"].error.startswith("no column for ts, lat, lon")
    assert report["broken.xlsx"].error == "unreadable: BadZipFile" and report["header.csv"].error == "no rows below the header"
    assert report["useless.csv"].error == "no row has a usable time and place" and report["useless.csv"].refused == 1 and report["titles.csv"].error is None
    assert not {"other.csv", "blank.csv", "broken.xlsx", "header.csv"} & set(rows)


def test_times(read):
    _, rows = read
    times = {f: [r.ts for r in own] for f, own in rows.items()}
    d = datetime
    assert times["titles.csv"] == [d(2026, 4, 3, 10), d(2026, 4, 13, 10, 0, 30), None, d(2026, 4, 14)]
    assert times["months.csv"] == [d(2026, 4, 13), d(2026, 3, 4), d(2026, 4, 5, 6, 7, 8), d(2025, 7, 17, 6, 11, 54), d(2026, 4, 5, 6, 7, 8), None, None]
    assert times["umlaut.csv"] == [d(2026, 4, 5, 7, 8), d(2026, 4, 5)] and times["wide.csv"] == [d(2026, 4, 5, 6, 7)]
    assert times["sheet.xlsx"] == [d(2026, 4, 5, 12), d(2026, 4, 5, 6, 7, 8), d(2026, 4, 5)]
    assert times["rows.json"] == [d(2025, 7, 17, 6, 11, 54), None] and times["lines.json"] == [d(2026, 4, 5, 6, 7, 8), d(2026, 4, 5)]


def test_places_speeds_and_rejects(read):
    _, rows = read
    own = rows["titles.csv"]
    assert [(r.row, r.lat, r.lon, r.speed, r.reject) for r in own] == [(5, 22.5, 805.0, 12, None), (6, 22.6, 80.6, 255, None), (8, 22.6, 80.6, None, "no timestamp"), (9, None, 80.6, 0, "no latitude")]
    assert [r.speed for r in rows["lines.json"]] == [2, 4]
    assert rows["sheet.xlsx"][2].reject == "no latitude" and rows["umlaut.csv"][0].lon == 2.5


def test_roles():
    assert U.roles_of(["Speed Limit", "speed", "GPS Latitude", "Long.", "Date"]) == {"ts": 4, "lat": 2, "lon": 3, "speed": 1}
    assert U.roles_of(["date", "time", "lat", "lng"]) == {"ts": 0, "lat": 2, "lon": 3, "day": 0, "clock": 1}
    assert U.header_of([["x"]] * 26 + [["lat", "lon"]]) is None and U.header_of([["x"]] * 25 + [["lat", "lon"]]) == 25
