import struct

import pytest

from lexiloom.sources import binary, formats

U4 = lambda *n: struct.pack(f"<{len(n)}I", *n)


def text(s, utf8=False):
    raw = s.encode("utf-8" if utf8 else "cp932")
    return U4(len(raw) + 1) + raw + b"\0"


def command(code, numbers=(), texts=(), utf8=False, route=False):
    out = bytes([len(numbers) + 1]) + U4(code, *numbers) + b"\0" + bytes([len(texts)]) + b"".join(text(t, utf8) for t in texts)
    return out + (b"\x01" + bytes(6) + U4(1) + b"\x05\x01" + U4(7) + b"\x01\0" if route else b"\0")


def commands(utf8):
    return [
        command(101, texts=["こんにちは"], utf8=utf8), command(102, (1,), ["はい", "No thanks"], utf8, True), command(150, (0x20,), ["Shown words"], utf8), command(150, (0,), ["Picture/a.png"], utf8),
        command(300, texts=["Event", "spoken words"], utf8=utf8), command(250, (1,), ["", "Costume", "Hair 1", ""], utf8), command(112, texts=["compared words"], utf8=utf8),
    ]


def game_map(utf8=False):
    list_ = commands(utf8)
    page = U4(0) + text("g", utf8) + bytes(47) + U4(1) + b"\x01\x00\x01\0" + U4(len(list_)) + b"".join(list_) + U4(4) + bytes(4) + b"\x7a"
    event = b"\x6f\x39\x30\0\0" + U4(3) + text("EV", utf8) + U4(1, 2, 1, 0) + b"\x79" + page + b"\x70"
    return binary.MAP + U4(85 if utf8 else 0, 1) + b"\x64" + text("x", utf8) + U4(0, 2, 1, 1) + bytes(24) + event + b"\x66"


def packed(data):
    head = bytearray(data[:25])
    head[20:24] = U4(0x65)
    block = binary.literal_block(data[25:])
    return bytes(head) + U4(len(data) - 25, len(block)) + block


IDS = {"ev:3/p:0/cmd:0/str:0": "こんにちは", "ev:3/p:0/cmd:1/str:0": "はい", "ev:3/p:0/cmd:1/str:1": "No thanks", "ev:3/p:0/cmd:2/str:0": "Shown words", "ev:3/p:0/cmd:4/str:1": "spoken words"}


@pytest.mark.parametrize("utf8", [False, True])
@pytest.mark.parametrize("change", [lambda d: d, packed])
def test_maps(utf8, change):
    data = change(game_map(utf8))
    found = {s.id: s.text for s in binary.read("Map.mps", data, {})}
    assert found == IDS and binary.write("Map.mps", data, found, {}) == data
    new = binary.write("Map.mps", data, {k: f"Olá {v}" for k, v in found.items()}, {})
    assert {s.id: s.text for s in binary.read("Map.mps", new, {})} == {k: ("Olá " if utf8 else "Ola ") + v for k, v in IDS.items()}
    assert binary.lookup_types("Map.mps", new) == ["Costume"]
    with pytest.raises(ValueError):
        binary.read("Map.mps", data[:-40], {})


def test_common_events():
    ten = U4(10)
    list_ = commands(False)
    event = b"\x8e" + U4(5, 0) + bytes(7) + text("name") + U4(len(list_)) + b"".join(list_) + text("") + text("d") + b"\x8f" + U4(11) + text("s") * 10 + bytes(5) + ten + bytes(10) + ten
    event += (U4(1) + text("c")) * 10 + ten + U4(1, 9) * 10 + bytes(29) + text("v") * 100 + b"\x91" + text("e") + b"\x92" + text("f") + U4(1) + b"\x92"
    data = binary.COMMON + b"\x01" + U4(1) + event + b"\x8f"
    found = {s.id: s.text for s in binary.read("CommonEvent.dat", data, {})}
    assert found == {k.replace("ev:3/p:0", "ce:5"): v for k, v in IDS.items()}
    new = binary.write("CommonEvent.dat", data, {"ce:5/cmd:0/str:0": "Hello"}, {})
    assert binary.read("CommonEvent.dat", new, {})[0].text == "Hello"
    with pytest.raises(ValueError):
        binary.read("CommonEvent.dat", binary.COMMON_UTF8 + b"\xcc", {})


def database(zero=b""):
    return zero + binary.DATABASE + b"\0" + b"FM\0" + b"\xc1" + U4(1) + b"\xfe\xff\xff\xff" + U4(0, 3, 1000, 2000, 2001) + U4(2) + U4(7) + text("Hair 1") + text("Long words") + U4(8) + text("x1") + text("Other words") + b"\xc1"


def encrypted(data):
    """A file that decrypts to data: its key is in its own bytes 0, 3 and 9, which differ from the data's in three bits at most."""
    near = [[data[k] ^ x for x in range(8)] for k in (0, 3, 9)]
    for a in near[0]:
        for b in near[1]:
            for c in near[2]:
                out = bytearray(data[:10])
                for seed, step in ((a, 1), (b, 2), (c, 5)):
                    for k in range(0, 10, step):
                        seed = (seed * 0x343FD + 0x269EC3) & 0x7FFFFFFF
                        out[k] ^= seed >> 28 & 0xFF
                if (out[0], out[3], out[9]) == (a, b, c):
                    return bytes(x ^ y ^ z for x, y, z in zip(data, binary.decrypted(bytes(out) + bytes(len(data) - 10)), bytes(out) + bytes(len(data) - 10)))
    raise AssertionError("no key")


def test_databases():
    data = database(b"\0")
    project = U4(1) + text("Costume") + U4(3) + text("a") * 3 + U4(2) + text("Hair 1") + text("Hair 2") + text("about") + U4(0) + U4(0) * 4
    found = lambda **o: [s.text for s in binary.read("DataBase.dat", data, o)]
    assert found() == ["Hair 1", "Long words", "Other words"]
    assert found(project=project, lookup_types=["Costume"]) == ["Long words", "Other words"]
    assert found(project=project, lookup_types=[]) == ["Hair 1", "Long words", "Other words"]
    new = binary.write("DataBase.dat", data, {"type:0/datum:1/str:1": "Outras palavras"}, {})
    assert binary.read("DataBase.dat", new, {})[-1].text == "Outras palavras" and len(new) == len(data) + 4
    hidden = encrypted(database())
    assert binary.plain_database(hidden) == database() and [s.text for s in binary.read("DataBase.dat", hidden, {})] == ["Hair 1", "Long words", "Other words"]


def test_headers_and_texts():
    body = binary.HEADER + b"\0" + U4(3) + b"abc" + U4(8) + text("My Game") + text("0000") + U4(1) + b"k" + text("Font") + text("") * 3 + text("hero") + U4(0) + b"tail"
    new = binary.write("Game.dat", body, {"game/title": "Meu Jogo!"}, {"font": "Other"})
    title, font, at, _ = binary.header_texts(new)
    assert (title.text, font.text) == ("Meu Jogo!", "Other") and new[at:] == U4(len(new)) + b"tail"
    assert binary.read("Game.dat", body, {})[0].text == "My Game" and binary.read("Game.dat", body, {"preserve_title": True}) == [] and binary.read("Game.dat", b"old", {}) == []
    assert binary.without_readings(r"\r[漢字,かんじ]です") == "漢字です" and binary.western("Olá “você”…") == 'Ola "voce"...'
    for t in ("Yes/No", "Hello", "漢字", "Two words"):
        assert binary.is_text(t), t
    for t in ("", "■", "SE/x", "bgm02", "ev_flag", "1+2", "<<GET_X>>", "a.png", "TRUE", "\\c[2]"):
        assert not binary.is_text(t), t
    assert binary.unpacked(b"\x14a\x01\x00\x00", 0) == b"a" * 9 and binary.read("readme.txt", b"x", {}) == []


def test_lookups_by_spark(spark):
    df = spark.createDataFrame([("A.mps", bytearray(game_map())), ("x.txt", bytearray(b"x"))], "name string, content binary")
    assert binary.looked_up(df) == ["Costume"] and binary.looked_up(df.where("name = 'x.txt'")) is None
    broken = df.union(spark.createDataFrame([("B.mps", bytearray(b"no"))], "name string, content binary"))
    assert binary.looked_up(broken) is None


def test_sidecars_and_fonts_in_a_folder(spark, tmp_path):
    data = tmp_path / "Data" / "BasicData"
    data.mkdir(parents=True)
    body = binary.HEADER + b"\0" + U4(3) + b"abc" + U4(8) + text("My Game") + text("0000") + U4(1) + b"k" + text("Font") + text("") * 3 + text("hero") + U4(0) + b"tail"
    (data / "Game.dat").write_bytes(body)
    (data / "DataBase.dat").write_bytes(database(b"\0"))
    (data / "CDataBase.dat").write_bytes(database(b"\0"))  # without a sidecar
    (data / "DataBase.project").write_bytes(U4(1) + text("Costume") + U4(3) + text("a") * 3 + U4(2) + text("Hair 1") + text("Hair 2") + text("about") + U4(0) + U4(0) * 4)
    kind = formats.FORMATS["binary"]
    found = formats.files(spark, str(tmp_path), kind)
    options = {"lookup_types": ["Costume"], "preserve_title": True, "font": "Other"}
    rows = formats.extracted(found, kind, options)
    assert sorted((r.id.split("#")[0], r.source) for r in rows.collect()) == [
        ("CDataBase.dat", "Hair 1"), ("CDataBase.dat", "Long words"), ("CDataBase.dat", "Other words"), ("DataBase.dat", "Long words"), ("DataBase.dat", "Other words"),
    ]
    targets = rows.where("source = 'Other words'").selectExpr("path", "id", "'Outras' target")
    new = {r.path.rsplit("/", 1)[1]: bytes(r.content) for r in formats.injected(found, targets, kind, options).collect()}
    assert binary.header_texts(new["Game.dat"])[1].text == "Other" and binary.header_texts(new["Game.dat"])[0].text == "My Game"
    assert [s.text for s in binary.read("DataBase.dat", new["DataBase.dat"], {})][-1] == "Outras" and sorted(new) == ["CDataBase.dat", "DataBase.dat", "Game.dat"]
    kept = formats.injected(found, targets.limit(0), kind, {"preserve_title": True})
    assert {r.path.rsplit("/", 1)[1]: bytes(r.content) for r in kept.collect()} == {f: (data / f).read_bytes() for f in new}
