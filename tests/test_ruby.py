import pytest

from lexiloom.sources import ruby


class Symbol(str):
    pass


def dump(value, symbols):
    if value is None or isinstance(value, bool):
        return {None: b"0", True: b"T", False: b"F"}[value]
    if isinstance(value, int):
        return b"i" + ruby.number_bytes(value)
    if isinstance(value, Symbol):
        if value in symbols:
            return b";" + ruby.number_bytes(symbols.index(value))
        symbols.append(value)
        return b":" + ruby.number_bytes(len(value.encode())) + value.encode()
    if isinstance(value, bytes):
        return value
    if isinstance(value, str):
        raw = value.encode()
        return b'I"' + ruby.number_bytes(len(raw)) + raw + ruby.number_bytes(1) + dump(Symbol("E"), symbols) + b"T"
    if isinstance(value, list):
        return b"[" + ruby.number_bytes(len(value)) + b"".join(dump(v, symbols) for v in value)
    if isinstance(value, dict):
        return b"{" + ruby.number_bytes(len(value)) + b"".join(dump(k, symbols) + dump(v, symbols) for k, v in value.items())
    name, attributes = value
    out = b"o" + dump(Symbol(name), symbols) + ruby.number_bytes(len(attributes))
    return out + b"".join(dump(Symbol(k), symbols) + dump(v, symbols) for k, v in attributes.items())


def command(code, *parameters):
    return ("RPG::EventCommand", {"@code": code, "@indent": 0, "@parameters": list(parameters)})


def game(*commands):
    page = ("RPG::Event::Page", {"@list": list(commands)})
    return b"\x04\x08" + dump(("RPG::Map", {"@display_name": "Town", "@width": 300, "@events": {1: ("RPG::Event", {"@name": "EV1", "@pages": [page]})}, "@data": b"u:\x0aTable\x08abc"}), [])


def test_numbers():
    for n in [0, 1, -1, 122, 123, 255, 256, 70000, -123, -124, -256, -257, 1 << 29]:
        stream = ruby.Stream(b"\x04\x08i" + ruby.number_bytes(n))
        assert stream.value() == n


def test_texts_and_edits():
    data = game(command(101, "face", 0, 0, 2), command(401, "<Ann>Hello"), command(102, ["Yes", "if(v[1]>0) No"], 1), command(355, 'text = "Hi there"'), command(108, "no"))
    e = "/@events/1/@pages/0/@list/"
    found = {s.id: s.text for s in ruby.read("Map001.rvdata2", data, {})}
    assert found == {"/@display_name": "Town", e + "1/p:0/0": "Ann", e + "1/p:0/1": "Hello", e + "2/choice:0": "Yes", e + "2/choice:1": "No", e + "3/p:0": "Hi there"}
    assert ruby.write("Map001.rvdata2", data, {}, {}) == ruby.write("Map001.rvdata2", data, found, {}) == data
    new = ruby.write("Map001.rvdata2", data, {k: f"PT<{v * 40}>" for k, v in found.items()}, {})
    again = {s.id: s.text for s in ruby.read("Map001.rvdata2", new, {})}
    assert again["/@display_name"] == f"PT<{'Town' * 40}>" and b"u:\x0aTable\x08abc" in new


def test_links_and_errors():
    shared = b'\x04\x08[\x08"\x0aHello@\x06o:\x0eRPG::Item\x06:\x0a@name@\x06'
    assert [s.text for s in ruby.read("x", shared, {})] == ["Hello"]
    assert b"Ola!" in ruby.write("x", shared, {"/2/@name": "Ola!"}, {})
    for bad in (b"", b"\x04\x09i\0", b"\x04\x08U", b'\x04\x08"\x7f', b"\x04\x08@\x0a"):
        with pytest.raises(ValueError):
            ruby.read("x", bad, {})
