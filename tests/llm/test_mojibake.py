import pytest

from faultline.llm.mojibake import READ_AS_MEANT, UTF8_READ_AS, _encoder, corpus_model, garbling_cost, pair_codes, repair, restored_texts, sample_model

TEXTS = {
    "de": "Ursache war eine ungültige Prüfsumme, Größe 1308 Kilobyte – ungewöhnlich hoch. Bitte nicht erneut ausführen, bevor die Sperre „island“ gelöst ist.",
    "fr": "Le contrôle a échoué sur 93 nœuds ; les autres ont réussi. Même symptôme qu’à l’été dernier, sans la même gravité. À prévoir : nettoyer le cache « indigo », où ça dérive.",
    "es": "¿Por qué se reintentó 120 veces? El bloqueo «delta» seguía activo; ¡los demás pasaron! El equipo revisará mañana el tamaño.",
    "pt": "ATENÇÃO: NÃO repetir antes de liberar o bloqueio. Três nós falharam na verificação; os demais estão saudáveis. Solução: fixar a versão.",
    "ru": "Откат к версии занял 1882 минуты, две очереди остались на паузе. Проверка не прошла на 53 узлах, остальные в порядке. Шаг остановился.",
    "en": "It’s the third time — each run cost 72 €. The naïve retry loop hid the “first” exception; 75 °C.",
}


def misread(text, read_as):
    """UTF-8 bytes read as a legacy encoding, undefined bytes kept as controls."""
    back = {b: c for c, b in _encoder(read_as).items()}
    return "".join(back[b] for b in text.encode())


@pytest.mark.parametrize("lang", TEXTS)
@pytest.mark.parametrize("read_as", UTF8_READ_AS)
def test_utf8_misread(lang, read_as):
    assert repair(misread(TEXTS[lang], read_as)) == TEXTS[lang]


@pytest.mark.parametrize("lang", TEXTS)
def test_two_layers(lang):
    assert repair(misread(misread(TEXTS[lang], "cp1252"), "cp1252")) == TEXTS[lang]


@pytest.mark.parametrize("lang", TEXTS)
def test_in_part(lang):
    garbled = TEXTS[lang] + "\n\n" + misread(TEXTS[lang], "cp1252") + " " + TEXTS[lang]
    assert repair(garbled) == TEXTS[lang] + "\n\n" + TEXTS[lang] + " " + TEXTS[lang]


@pytest.mark.parametrize(("lang", "read_as", "meant"), [("de", "cp437", "cp1252"), ("es", "cp437", "cp1252"), ("pt", "cp437", "cp1252"), ("ru", "cp1252", "cp1251"), ("ru", "cp1251", "koi8-r"), ("ru", "cp1251", "cp866"), ("fr", "cp437", "cp1252")])
def test_legacy_read_as_another(lang, read_as, meant):
    assert (read_as, meant) in READ_AS_MEANT
    text = TEXTS[lang].replace("–", "-") if meant in ("koi8-r", "cp866") else TEXTS[lang]
    back = {b: c for c, b in _encoder(read_as).items()}
    garbled = "".join(back[b] for b in text.encode(meant))
    assert repair(garbled) == text
    assert repair(TEXTS["en"] + "\n\n" + garbled) == TEXTS["en"] + "\n\n" + text


@pytest.mark.parametrize("text", [*TEXTS.values(), "", "plain", "naïve NAÏVE 日本語 Ελλάδα 1×2", "ﬁrst １２ ca​fé", "re­tried co­ö­pe"])
def test_clean_stays(text):
    assert repair(text) == text


CLEAN = [
    "Zażółć gęślą jaźń. Wdrożenie nie powiodło się, ponieważ serwer zwrócił błąd; spróbuj ponownie później.",
    "Sestavení se nezdařilo, protože chyběla závislost. Zkontrolujte prosím nastavení úložiště a spusťte ho znovu.",
    "Zostavenie zlyhalo, pretože chýbala závislosť. Skontrolujte nastavenie a spustite ho znova.",
    "A telepítés sikertelen volt, mert hiányzott egy függőség. Ellenőrizze a beállításokat, majd próbálja újra.",
    "Derleme başarısız oldu çünkü bir bağımlılık eksikti. Lütfen ayarları gözden geçirip yeniden deneyin; iş ağır.",
    "Η κατασκευή απέτυχε επειδή έλειπε μια εξάρτηση. Ελέγξτε τις ρυθμίσεις και δοκιμάστε ξανά.",
    "Збірка не вдалася, бо бракувало залежності. Перевірте налаштування й спробуйте ще раз; її джерело невідоме.",
    "Compilarea a eșuat deoarece lipsea o dependență. Verificați setările și încercați din nou, vă rugăm să așteptați.",
    "Fordítás után a gyűrű erősebb, őszintén szólva tűrhető.", "Łukasz Dvořák", "Ağrı", "Škoda přílohy", "El Niño", "Ærø å", "CAFÉ»", "NAÏVE “Ä” »Ö«",
]


@pytest.mark.parametrize("text", CLEAN)
def test_clean_text_of_languages_the_corpus_lacks_stays(text):
    assert repair(text) == text


@pytest.mark.parametrize("lang", TEXTS)
@pytest.mark.parametrize("layers", [3, 5, 7])
def test_any_number_of_layers(lang, layers):
    garbled = TEXTS[lang]
    for _ in range(layers):
        garbled = misread(garbled, "cp1252")
    assert repair(garbled) == TEXTS[lang]


def test_pairs_belong_to_their_texts():
    documents, codes = pair_codes(["é", "", "aé ü", "z"])
    pairs = [(int(d), chr(c >> 21), chr(c & (1 << 21) - 1)) for d, c in zip(documents, codes, strict=True)]
    assert pairs == [(0, "\x01", "é"), (0, "é", "\x01"), (2, "a", "é"), (2, "é", " "), (2, "\x01", "ü"), (2, "ü", "\x01")]
    assert pair_codes([])[1].size == pair_codes(["plain"])[1].size == 0


def test_corpus_statistics(spark):
    clean = ["Das läuft für zehn Prüfungen", "três nós", "été"] * 400
    docs = spark.createDataFrame([(t,) for t in [*clean, misread("für", "cp1252")] + ["plain", None]], "text string")
    model = corpus_model(docs.where("text is not null"))
    assert model.documents == 1200 and model.cost(" für ") == 0 and min(model.counts.values()) == 400
    got = restored_texts(docs.selectExpr("monotonically_increasing_id() as doc_id", "text")).collect()
    assert [r["restored_text"] for r in got] == ["für"]


def test_cost():
    assert garbling_cost("plain") == 0 and garbling_cost("PrÃ¼fung") > garbling_cost("Prüfung") == 0


def test_frame(spark):
    docs = [(1, None), (2, ""), (3, TEXTS["de"]), (4, misread(TEXTS["de"], "cp1252")), (5, "La ejecuci�n"), (6, misread("La ejecuci�n á", "cp1252")), (4, misread(TEXTS["de"], "cp1252")), (None, misread(TEXTS["ru"], "cp1251"))]
    got = restored_texts(spark.createDataFrame([(*d, "") for d in docs], "doc_id bigint, text string, restored_text string")).collect()
    assert sorted((tuple(r) for r in got), key=repr) == sorted([(4, TEXTS["de"]), (4, TEXTS["de"]), (5, None), (6, None), (None, TEXTS["ru"])], key=repr)
    assert restored_texts(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
    assert sample_model().suspicious(["plain", "für", misread("für", "cp1252")]).tolist() == [False, False, True]
