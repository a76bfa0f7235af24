from __future__ import annotations

import corpus_pipeline
from fathomline.llm import quality

PROSE = {
    "ru": "Вчера утром старый рыбак вышел на берег реки и долго смотрел на воду, потому что лодка его сына ещё не вернулась. Он знал, что ветер ночью был сильным, но верил, что мальчик "
    "умеет держать руль и не боится волн. К полудню на горизонте показался белый парус, люди на пристани закричали от радости, а старик только снял шапку, вытер глаза и тихо пошёл домой готовить обед.",
    "pl": "Wczoraj rano stary rybak wyszedł na brzeg rzeki i długo patrzył w wodę, ponieważ łódź jego syna jeszcze nie wróciła. Wiedział, że wiatr w nocy był silny, ale wierzył, że chłopiec "
    "potrafi trzymać ster i nie boi się fal. W południe na horyzoncie pojawił się biały żagiel, ludzie na przystani krzyczeli z radości, a starzec tylko zdjął czapkę, otarł oczy i cicho poszedł do domu gotować obiad dla wszystkich.",
    "fi": "Eilen aamulla vanha kalastaja käveli joen rannalle ja katsoi pitkään vettä, koska hänen poikansa vene ei ollut vielä palannut. Hän tiesi, että tuuli oli yöllä kova, mutta uskoi, että poika "
    "osaa pitää peräsintä eikä pelkää aaltoja. Keskipäivällä taivaanrannassa näkyi valkoinen purje, ihmiset laiturilla huusivat ilosta, ja vanhus vain otti lakin päästään, pyyhki silmänsä sekä lähti hiljaa kotiin laittamaan ruokaa kaikille, jotka olivat odottaneet koko päivän.",
    "sw": "Jana asubuhi mvuvi mzee alikwenda ukingoni mwa mto akatazama maji kwa muda mrefu, kwa sababu mashua ya mwanawe ilikuwa haijarudi bado. Alijua kwamba upepo wa usiku ulikuwa mkali, lakini aliamini kwamba kijana "
    "anaweza kushika usukani wala haogopi mawimbi. Saa sita mchana tanga jeupe lilionekana mbali, watu bandarini walipiga kelele kwa furaha, na mzee alivua kofia yake, akafuta macho, akaenda nyumbani polepole kupika chakula cha mchana.",
}
JUNK = " ".join(f"zz{i}" for i in range(200))


def test_clean_documents_of_other_languages_stay(spark):
    rows = [(k, t, k) for k, t in PROSE.items()] + [(f"{k} unlabelled", PROSE[k], None) for k in ("ru", "pl", "fi")]
    rows += [(f"junk {k}", JUNK, k) for k in ("en", "pl", None)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, lang string")
    got = {r.doc_id: r for r in quality.quality_rules(docs).select("doc_id", "quality.*").collect()}
    assert {k for k, r in got.items() if not r.kept} == {"junk en", "junk pl", "junk None"}, got
    no_label = quality.quality_rules(docs.drop("lang")).select("doc_id", "quality.kept").collect()
    assert {r.doc_id for r in no_label if r.kept} == {k for k in got if not k.startswith("junk")} - {"sw"}


def test_quality_stage_keeps_a_fifth_language(spark):
    docs = spark.createDataFrame([(1, PROSE["ru"], "ru", "web", 1), (2, JUNK, "en", "web", 1)], "doc_id int, text string, lang string, source string, n_chars int")
    assert [r.doc_id for r in corpus_pipeline.quality_stage(spark, docs, "").collect()] == [1]
