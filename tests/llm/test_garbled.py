import pytest

from evigrain.llm import garbled


def garble(text: str, *pages: str) -> str:
    for p in pages:
        to = garbled._tables(p)[1]
        text = "".join(to[b] if b > 127 else chr(b) for b in text.encode())
    return text


PAGES = [("cp1251+", "cp1251+"), ("cp1252+", "cp1251+"), ("cp1251+", "cp1252+"), ("cp1252+", "cp1252+"), ("cp1251+",) * 3, ("cp1252+",) * 3]


@pytest.mark.parametrize("pages", PAGES, ids="-".join)
@pytest.mark.parametrize("word", ["изменение", "журнал", "データベース", "障害対応", "configuração"])
def test_repeated_damage_is_found_and_restored(word, pages):
    text = f"Step 3: {word} (checked)."
    case, restored, layers, whole = garbled.repair(text.replace(word, garble(word, *pages)))
    assert (case, restored, whole, len(layers)) == (True, text, True, len(pages))


def test_an_odd_character_does_not_hide_its_neighbours():
    case, restored, _, _ = garbled.repair("Note " + garble("Кыргыз ҙ түзөтүү", "cp1252+"))
    assert case and "Кыргыз" in restored


@pytest.mark.parametrize("text", ["Дії: Ві, Ні, Ді", "ͷΑΒΓ Αθήνα «λόγος»", "Ђ Ѓ Ќ Џ", "ÇA À NOËL", "ˆ ˜ ˇ ˘ ˙ ˚", "Đường phố Hà Nội", "שלום", "한국어", "ўсё"])
def test_rare_characters_are_no_case(text):
    assert not garbled.repair(text)[0]


@pytest.mark.parametrize("text", ["مرحبا بالعالم هذا نص", "שלום עולם זה טקסט", "สวัสดีชาวโลก", "안녕하세요 세계", "Καλημέρα κόσμε", "नमस्ते दुनिया"])
@pytest.mark.parametrize("page", ["cp1252+", "latin-1", "cp1251+"])
def test_any_script_is_restored(text, page):
    case, restored, _, whole = garbled.repair("Note: " + garble(text, page) + " end.")
    assert (case, restored, whole) == (True, "Note: " + text + " end.", True)


@pytest.mark.parametrize("text, real", [("Καλημέρα κόσμε", "cp1253"), ("Привіт, як справи сьогодні їжак", "cp1251"), ("Проверка журнала завершена", "koi8-r")])
def test_page_swaps_are_read_in_their_own_alphabet(text, real):
    case, restored, _, whole = garbled.repair(text.encode(real).decode("latin-1"))
    assert (case, restored, whole) == (True, text, True)


def test_a_text_with_damage_left_is_not_whole():
    _, restored, _, whole = garbled.repair("Note " + garble("проверка журнала", "cp1252+") + " aprГЁs")
    assert "проверка" in restored and not whole
    assert not garbled.repair("lost � character")[3]


def test_null_keys_empty_tables_and_clashing_columns(spark):
    schema = "doc_id bigint, text string, layers int, restored string"
    rows = [(None, "Ð¿Ñ€Ð¾Ð²ÐµÑ€ÐºÐ°", 1, "x"), (1, None, 1, "x"), (2, "", 1, "x"), (3, "plain", 1, "x")]
    got = garbled.repair_garbled(spark.createDataFrame(rows, schema)).collect()
    assert [(r.doc_id, r.restored) for r in got] == [(None, "проверка")]
    assert garbled.repair_garbled(spark.createDataFrame([], schema)).collect() == []
