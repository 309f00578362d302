import json

from lexiloom.functions import gametext
from lexiloom.functions.masking import Masker, unmasked
from lexiloom.sources import documents
from lexiloom.sources.formats import FORMATS, planned_columns


def read(kind, name, text, **options):
    return {s.id: (s.text, s.kind) for s in FORMATS[kind].read(name, text.encode(), options)}


def wrap(kind, name, text, **options):
    targets = {i: f"PT<{t}>" for i, (t, _) in read(kind, name, text, **options).items()}
    return FORMATS[kind].write(name, text.encode(), targets, options).decode()


def test_json_leaves_and_edits():
    doc = '﻿{ "id":1.50, "a~/b": {"name": "Hero & <b>", "list":["x",{"y":"z\\u00e9"}]},\r\n\t"text":"T" , "e":[], "f":{} }'
    mark, text = documents.text_of(doc.encode())
    found = list(documents.leaves(text))
    assert [(x.pointer, x.key) for x in found if isinstance(x.value, str)] == [("/a~0~1b/name", "name"), ("/a~0~1b/list/0", "list"), ("/a~0~1b/list/1/y", "y"), ("/text", "text")]
    assert documents.edited(text, {}) == text
    assert documents.edited(text, {"/text": 'q"\n<é>', "/none": "x"}) == text.replace('"T"', '"q\\"\\n<é>"')
    broken = b'{"a": "\xff"}'
    assert documents.bytes_of(documents.text_of(broken)[1]) == broken


def test_json_texts():
    doc = json.dumps({"id": 1, "image": "img/a.png", "name": "Harold", "title": "Yes/No", "note": "\\C[2]", "text": "$gameX.a", "dialogue": ["Hello there", "12.5", "se/x.ogg"], "other": "no"})
    assert read("json", "a.json", doc) == {"/name": ("Harold", "menu"), "/title": ("Yes/No", "menu"), "/dialogue/0": ("Hello there", "dialogue")}
    assert '"Harold"' not in wrap("json", "a.json", doc) and "PT<Harold>" in wrap("json", "a.json", doc)
    assert "/other" in read("json", "a.json", doc, keys=None)


def test_tables():
    assert read("csv", "a.csv", "id;speaker;text\r\n1;A;Hello\r\n2;B;12\r\n3;C;■ x\r\n") == {"row:1/col:2": ("Hello", "db")}
    assert wrap("csv", "a.csv", "id;speaker;text\r\n1;A;Hello\r\n") == "id;speaker;text\r\n1;A;PT<Hello>\r\n"
    two = "﻿key,en,es\na,Hi,Hola\nb,Bye\n"
    assert wrap("csv", "a.csv", two, src="en", tgt="pt") == "﻿key,en,es,pt\na,Hi,Hola,PT<Hi>\nb,Bye,,PT<Bye>\n"
    assert read("csv", "a.csv", "key,en,pt\na,Hi,Oi\nb,Bye,\n", src="en", tgt="pt-BR") == {"row:2/col:1": ("Bye", "db")}
    assert planned_columns(["English", "x"], "en", "pt")[2] == "Portuguese" and planned_columns(["EN", "x"], "en", "pt")[2] == "PT"
    assert planned_columns(["a", "id"], "", "")[0] == [0] and planned_columns(["a", "b", "c"], "", "")[0] == []
    assert planned_columns(["a", "Notes "], "", "", ["notes"])[0] == [1]


def test_lines():
    text = "/comment\r\n\tこんにちは\r\n名前：\r\nlast"
    data = text.encode("cp932")
    slots = FORMATS["lines"].read("a.txt", data, {})
    assert [s.id for s in slots] == ["line:1", "line:2", "line:3"]
    out = FORMATS["lines"].write("a.txt", data, {"line:1": "Hi\nthere", "line:2": "Name:"}, {}).decode("cp932")
    assert out == "/comment\r\n\tHi there\r\nName：\r\nlast"


def command(code, *parameters):
    return {"code": code, "indent": 0, "parameters": list(parameters)}


def test_maps():
    page = [
        command(101, "face", 0, 0, 2, "Bob"), command(401, "<Ann>Hello \\C[1]you"), command(102, ["if(v[1]>0) Go", "Stay", "\\picture[x]"], 1), command(402, 1, "Stay"),
        command(355, '$gameMessage.add("Hi \\"you\\""); $gameScreen.OriginalMessage("a b", \'c d\')'), command(356, "addLog Found it"), command(357, "P", "c", "", {"text": "Words", "id": "x y", "n": "Auto"}),
        command(122, 1, 1, 0, 4, '"Some words";'), command(122, 1, 1, 0, 0, "Some words"), command(205, 0, {"list": [{"code": 45, "parameters": ['text = "Up we go"']}, {"code": 1}]}), command(108, "note to self"),
    ]
    doc = json.dumps({"displayName": "Town", "events": [None, {"id": 1, "pages": [{"list": page}]}, False]}, ensure_ascii=False, indent=1)
    e = "event:1/page:0/cmd:"
    assert read("game", "Map001.json", doc) == {
        "map:displayName": ("Town", "menu"), e + "0/speaker": ("Bob", "dialogue"), e + "1/0": ("Ann", "dialogue"), e + "1/1": ("Hello \\C[1]you", "dialogue"), e + "2/choice:0": ("Go", "choice"),
        e + "2/choice:1": ("Stay", "choice"), e + "3": ("Stay", "choice"), e + "4/0": ('Hi "you"', "script"), e + "4/1": ("a b", "script"), e + "4/2": ("c d", "script"), e + "5": ("Found it", "script"),
        e + "6/text": ("Words", "script"), e + "7": ("Some words", "script"), e + "9/step:0": ("Up we go", "script"),
    }
    new = json.loads(wrap("game", "Map001.json", doc))
    cmds = new["events"][1]["pages"][0]["list"]
    assert cmds[1]["parameters"] == ["<PT<Ann>>PT<Hello \\C[1]you>"] and cmds[2]["parameters"][0][0] == "if(v[1]>0) PT<Go>"
    assert cmds[4]["parameters"][0].startswith('$gameMessage.add("PT<Hi \\"you\\">");') and cmds[7]["parameters"][4] == '"PT<Some words>";'
    assert FORMATS["game"].write("Map001.json", doc.encode(), {}, {}).decode() == doc


def test_records_and_system():
    items = json.dumps([None, {"id": 1, "name": "Sword", "description": "Cuts", "note": "<Desc: long text> <x:1>"}, {"name": "", "description": "hidden"}])
    assert set(read("game", "Items.json", items)) == {"item:1/field:name", "item:1/field:description", "item:1/field:note"}
    assert "<Desc: PT<long text>>" in wrap("game", "Items.json", items)
    system = json.dumps({"gameTitle": "Quest", "currencyUnit": "G", "switches": ["s"], "elements": ["", "Fire"], "terms": {"basic": ["Level"], "messages": {"a": "Always Dash"}}})
    assert set(read("game", "System.json", system)) == {"gameTitle", "currencyUnit", "elements/1", "terms/basic/0", "terms/messages/a"}


def test_plugins():
    inner = json.dumps({"title": "Open the door", "image": "Some Picture", "list": json.dumps(["Deep text here", "x"])})
    doc = "// head\nvar $plugins =\n[\n" + json.dumps({"name": "Menu", "status": True, "description": "d", "parameters": {"Cmd": inner, "Label": "Options", "bgm": "A song", "code": "a(b)"}}) + ",\n" + json.dumps({"name": "Off", "status": False, "parameters": {"t": "Not this"}}) + "\n];\n"
    p = "plugin:0:Menu/param:"
    assert read("game", "plugins.js", doc) == {p + "Cmd/list/0": ("Deep text here", "menu"), p + "Cmd/title": ("Open the door", "menu"), p + "Label": ("Options", "menu")}
    new = wrap("game", "plugins.js", doc)
    plugin = json.loads(new[new.index("[") : new.rindex("]") + 1])[0]["parameters"]
    assert json.loads(json.loads(plugin["Cmd"])["list"])[0] == "PT<Deep text here>" and plugin["Label"] == "PT<Options>" and new.startswith("// head\nvar $plugins =\n[\n")


def test_masks():
    masker = Masker()
    text, found = masker.mask("\\C[2]a\\C[2]<font color=\\C[3]>b")
    assert text.count("__XTOK_") == 3 and "<font color=\\C[3]>" in found.values()
    assert unmasked(text.replace("__XTOK_0__", "__ xtok_0 __"), found) == "\\C[2]a\\C[2]<font color=\\C[3]>b"
    assert masker.mask("__XTOK_0__ \\.")[0] == "__XTOK_0__ __XTOK_1__"
    game = Masker(gametext.GAME_PATTERNS)
    assert game.mask("show_if(v[1] > f(2)) Go \\C[1]!")[1].keys() == {"__XTOK_0__", "__XTOK_1__"}
    assert game.mask("If (you) go, es (sic)")[1] == {}
    assert game.mask("x!v[1] av[2]")[1] == {"__XTOK_0__": "!v[1]"}


def test_code():
    for t in ("", "TRUE", "1,200", "const x", "$gameX.y", "if (a == b) {", "\\C[1]\\V[2]", "show_if(v[1]) ", "a && b"):
        assert gametext.is_code(t), t
    for t in ("Hello", "If (you) go", "$100 for it", "Auto"):
        assert not gametext.is_code(t), t
    assert gametext.is_code("Auto", parameter=True)
