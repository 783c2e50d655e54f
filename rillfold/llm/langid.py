"""The language of each document, and of each segment of one that mixes languages.

Discrimination is hierarchical: linear support vector machines first tell language families apart, one
against the rest, then one-versus-one machines separate the languages within a family, which vote. All are
trained on the driver on a bounded sample of labelled documents (about `train_docs` of each language) and a few
sentences of each language kept here; labels the first round of training contradicts are left out of the second. The
machines are columns of one matrix over hashed character n-grams, so a sentence costs one gather and one sum.

Documents are read whole, where they lie, without a shuffle: prose is taken out, cut into sentences,
and the sentences of all documents of a batch are scored together. A language counts for a document if it
holds enough letters of its prose; sentences too short or too near a border follow the rest of their block or document.

Defined cases: null, empty or blank texts, and texts with fewer than `MIN_LETTERS` letters of prose, have no
language; a null or unknown label names no language; without any labelled document the kept sentences alone train
the machines; repeated documents give repeated results; empty tables give no rows.
"""

from __future__ import annotations

import io
import itertools
import json
import unicodedata
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillfold.llm import prose
from rillfold.session import shared_dir, written
from rillfold.sources.layout import table_state

@dataclass(frozen=True)
class Languages:
    """Families of languages by code, from which the machines follow: one for each family, and one for each pair within one."""

    families: tuple[tuple[str, tuple[str, ...]], ...]

    @classmethod
    def of(cls, families: dict[str, Iterable[str]]) -> Languages:
        return cls(tuple((k, tuple(sorted(v))) for k, v in families.items()))

    @classmethod
    def read(cls, rows: DataFrame) -> Languages:
        """From a table `lang_code, family`, a few dozen rows."""
        out: dict[str, list[str]] = defaultdict(list)
        for r in rows.where("lang_code is not null and family is not null").select("lang_code", "family").distinct().orderBy("family", "lang_code").collect():
            out[r.family].append(r.lang_code)
        return cls.of(out)

    @cached_property
    def all(self) -> list[str]:
        return sorted(itertools.chain.from_iterable(g for _, g in self.families))

    @cached_property
    def pairs(self) -> list[tuple[str, str]]:
        return [p for _, g in self.families for p in itertools.combinations(g, 2)]

    @cached_property
    def family_of(self) -> dict[str, int]:
        return {x: k for k, (_, g) in enumerate(self.families) for x in g}

    def check(self, codes: Iterable[str]) -> None:
        """Codes of no family can't be told apart, so labels that name them are refused."""
        if unknown := sorted(set(codes) - set(self.all)):
            raise ValueError(f"languages without a family: {', '.join(unknown)}; give families that have them")


#: The families of the languages that the kept sentences are in.
DEFAULT = Languages.of({"germanic": ["de", "en", "nl"], "romance": ["es", "fr", "it", "pt"], "slavic": ["pl", "ru", "uk"], "han": ["ja", "zh"]})

BINS = 1 << 15
ORDERS = (1, 2, 3, 4)
#: Labelled documents of each language that train the machines, in expectation; sentences of each language at most.
TRAIN_DOCS, TRAIN_SENTENCES = 250, 900
#: Longer documents don't train, so the sample on the driver is bounded; they are labelled like all others.
TRAIN_CHARS = 100_000
#: A document with fewer letters of prose has no language.
MIN_LETTERS = 10
#: Letters and confidence that a sentence needs to count by itself, and to bring in another language than its document's.
OWN_LETTERS, OWN_CONFIDENCE = 8, 0.6
OTHER_LETTERS, OTHER_CONFIDENCE = 15, 0.8
#: The same in a script that the document's language isn't written in. Latin letters are no such sign, as names are written in them everywhere.
SCRIPT_LETTERS = 4
SCRIPTS = {"ja": {"Han", "Hiragana", "Katakana"}, "zh": {"Han"}, "ru": {"Cyrillic"}, "uk": {"Cyrillic"}}

# A few sentences of each language, so that no machine is ever without examples.
SEEDS = {
    "en": "This change adds a test for the parser. We should not read the file before it has been closed. Please review the other functions as well, because they were never checked. Fixed the wrong order of arguments. It was too slow when there were many users, which is why the old code has been removed.",
    "de": "Diese Änderung fügt einen Test für den Parser hinzu. Wir sollten die Datei nicht lesen, bevor sie geschlossen wurde. Bitte auch die anderen Funktionen prüfen, denn sie wurden nie getestet. Die falsche Reihenfolge der Argumente ist behoben. Es war zu langsam, wenn es viele Benutzer gab, deshalb wurde der alte Code entfernt.",
    "nl": "Deze wijziging voegt een test toe voor de parser. We moeten het bestand niet lezen voordat het gesloten is. Kijk ook naar de andere functies, want die zijn nooit getest. De verkeerde volgorde van de argumenten is hersteld. Het was te traag als er veel gebruikers waren, daarom is de oude code verwijderd.",
    "es": "Este cambio añade una prueba para el analizador. No debemos leer el archivo antes de que se haya cerrado. Por favor, revisad también las otras funciones, porque nunca se comprobaron. Se corrige el orden de los argumentos. Era demasiado lento cuando había muchos usuarios, por eso hemos quitado el código viejo.",
    "fr": "Ce changement ajoute un test pour l'analyseur. Nous ne devons pas lire le fichier avant qu'il soit fermé. Merci de vérifier aussi les autres fonctions, car elles n'ont jamais été testées. L'ordre des arguments est corrigé. C'était trop lent quand il y avait beaucoup d'utilisateurs, donc l'ancien code est supprimé.",
    "it": "Questa modifica aggiunge una prova per il parser. Non dobbiamo leggere il file prima che sia stato chiuso. Per favore controllate anche le altre funzioni, perché non sono mai state provate. Corretto l'ordine degli argomenti. Era troppo lento quando c'erano molti utenti, quindi il vecchio codice è stato tolto.",
    "pt": "Esta alteração acrescenta um teste para o analisador. Não devemos ler o ficheiro antes de ele ter sido fechado. Por favor, vejam também as outras funções, porque nunca foram testadas. A ordem dos argumentos foi corrigida. Era demasiado lento quando havia muitos utilizadores, por isso o código antigo foi retirado.",
    "pl": "Ta zmiana dodaje test parsera. Nie powinniśmy czytać pliku, zanim nie zostanie zamknięty. Proszę sprawdzić także inne funkcje, ponieważ nigdy nie były testowane. Poprawiono złą kolejność argumentów. Działało to zbyt wolno, kiedy było wielu użytkowników, dlatego stary kod został usunięty.",
    "ru": "Это изменение добавляет тест для разбора. Мы не должны читать файл до того, как он закрыт. Пожалуйста, проверьте и другие функции, потому что их никогда не проверяли. Исправлен неверный порядок аргументов. Это было слишком медленно, когда было много пользователей, поэтому старый код удалён.",
    "uk": "Ця зміна додає тест для розбору. Ми не повинні читати файл до того, як його закрито. Будь ласка, перевірте й інші функції, бо їх ніколи не перевіряли. Виправлено неправильний порядок аргументів. Це було надто повільно, коли було багато користувачів, тому старий код вилучено.",
    "ja": "この変更では解析処理のテストを追加します。ファイルを閉じる前に読み込んではいけません。他の関数も一度も確認していないので、見てください。引数の順番が間違っていたのを直しました。利用者が多いと遅すぎたため、古いコードを削除しました。",
    "zh": "这个更改为解析器添加了测试。文件关闭之前我们不应该读取它。其他函数从来没有检查过，请也看一下。修正了参数的错误顺序。用户很多的时候太慢了，所以删除了旧代码。",
}


def plain(text: str) -> str:
    """Latin letters without their marks; other scripts as they are."""
    return "".join(c if ord(c) > 0x24F else unicodedata.normalize("NFKD", c)[0] for c in text)


def features(sentences: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed n-grams of all sentences: bins, the sentence of each, and the number of each sentence's."""
    padded = [f" {s.lower()} " for s in sentences]
    codes = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(padded), dtype=np.int32), [len(p) for p in padded])
    bins, owners = [], []
    h = np.zeros(len(codes), dtype=np.uint64)
    for n in range(1, max(ORDERS) + 1):
        m = len(codes) - n + 1
        if m <= 0:
            break
        h = (h[:m] + codes[n - 1 : n - 1 + m] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
        inside = owner[:m] == owner[n - 1 : n - 1 + m]
        x = h[inside]
        bins.append((x >> np.uint64(40)).astype(np.int64) & (BINS - 1))
        owners.append(owner[:m][inside])
    b, o = (np.concatenate(v) if v else np.zeros(0, dtype=np.int64) for v in (bins, owners))
    order = np.argsort(o, kind="stable")
    return b[order], o[order], np.bincount(o, minlength=len(sentences))


def scores(weights: np.ndarray, sentences: list[str]) -> np.ndarray:
    """The value of every machine for every sentence."""
    out = np.zeros((len(sentences), weights.shape[1]), dtype=np.float32)
    step = 4096
    for k in range(0, len(sentences), step):
        b, _, n = features(sentences[k : k + step])
        if len(b):
            starts = np.concatenate([[0], np.cumsum(n)[:-1]])
            some = n > 0
            sums = np.add.reduceat(weights[b], starts[some], axis=0)
            out[k : k + step][some] = sums / np.sqrt(n[some])[:, None]
    return out


@dataclass(frozen=True)
class Model:
    """weights: a column for each family, then for each pair. slope: of the logistic that turns margins into confidence."""

    weights: np.ndarray
    slope: float = 3.0
    languages: Languages = DEFAULT

    def predict(self, sentences: list[str]) -> tuple[list[str], np.ndarray]:
        """Language and confidence of each sentence."""
        if not sentences:
            return [], np.zeros(0)
        s = scores(self.weights, sentences)
        lang = self.languages
        n = len(lang.families)
        family = s[:, :n].argmax(axis=1)
        ranked = np.sort(s[:, :n], axis=1)
        sure = 1 / (1 + np.exp(-self.slope * (ranked[:, -1] - ranked[:, -2]))) if n > 1 else np.ones(len(sentences))
        # Votes of the machines within each family, ties by the sum of their margins.
        votes = np.full((len(sentences), len(lang.all)), -1e9, dtype=np.float64)
        least = {}
        for k, (_, group) in enumerate(lang.families):
            for a in group:
                total = np.zeros(len(sentences))
                low = np.full(len(sentences), np.inf)
                for j, (x, y) in enumerate(lang.pairs):
                    if a in (x, y):
                        v = s[:, n + j] * (1 if a == x else -1)
                        total += np.sign(v) + np.tanh(v) / 100
                        low = np.minimum(low, v)
                i = lang.all.index(a)
                votes[:, i] = np.where(family == k, total, -1e9)
                least[i] = low
        best = votes.argmax(axis=1)
        within = np.array([least[i] for i in range(len(lang.all))])[best, np.arange(len(sentences))]
        return [lang.all[i] for i in best], sure / (1 + np.exp(-self.slope * 2 * np.minimum(within, 1e3)))

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez_compressed(out, weights=self.weights, slope=self.slope, families=json.dumps(self.languages.families))
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> Model:
        z = np.load(io.BytesIO(data))
        return cls(z["weights"], float(z["slope"]), Languages(tuple((k, tuple(g)) for k, g in json.loads(str(z["families"])))))

    def save(self, spark: SparkSession, folder: str) -> None:
        spark.createDataFrame([(bytearray(self.to_bytes()),)], "model binary").coalesce(1).write.mode("overwrite").parquet(folder)

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> Model:
        return cls.from_bytes(bytes(spark.read.parquet(folder).first()[0]))


def _fit(sentences: list[str], labels: list[str], lang: Languages, epochs: int = 6, batch: int = 256, rate: float = 0.5, decay: float = 1e-5, seed: int = 5) -> np.ndarray:
    """All machines at once, squared hinge loss, by AdaGrad over batches."""
    n, k = len(lang.families), len(lang.families) + len(lang.pairs)
    target = np.zeros((len(sentences), k), dtype=np.float32)
    family = np.array([lang.family_of[x] for x in labels])
    target[:, :n] = np.where(family[:, None] == np.arange(n)[None, :], 1, -1)
    names = np.array(labels)
    for j, (a, b) in enumerate(lang.pairs):
        target[names == a, n + j], target[names == b, n + j] = 1, -1
    # Languages with fewer sentences weigh as much as the others.
    count = {x: (names == x).sum() for x in set(labels)}
    weight = np.array([len(labels) / len(count) / count[x] for x in labels], dtype=np.float32)
    w, g = np.zeros((BINS, k), dtype=np.float32), np.full((BINS, k), 1e-3, dtype=np.float32)
    rng = np.random.default_rng(seed)
    for epoch in range(epochs):
        order = rng.permutation(len(sentences))
        for at in range(0, len(order), batch):
            rows = order[at : at + batch]
            b, o, c = features([sentences[i] for i in rows])
            if not len(b):
                continue
            scale = 1 / np.sqrt(np.maximum(c, 1))
            starts = np.concatenate([[0], np.cumsum(c)[:-1]])
            some = c > 0
            s = np.zeros((len(rows), k), dtype=np.float32)
            s[some] = np.add.reduceat(w[b], starts[some], axis=0) * scale[some, None]
            t = target[rows]
            loss = np.where(t != 0, np.maximum(0, 1 - t * s), 0) * -t * weight[rows, None] * scale[:, None]
            by = np.argsort(b, kind="stable")
            u, first = np.unique(b[by], return_index=True)
            step = np.add.reduceat(loss[o[by]], first, axis=0) / len(rows) + decay * w[u]
            g[u] += step * step
            w[u] -= rate * (0.7**epoch) * step / np.sqrt(g[u])
    return w


def train(labelled: list[tuple[int, str, str]], seed: int = 3, lang: Languages = DEFAULT) -> Model:
    """A model from `(doc_id, language, text)` rows; a label may be wrong, and a text may mix languages."""
    by_language: dict[str, list[tuple[int, str]]] = defaultdict(list)
    for doc, language, text in sorted(labelled, key=lambda r: (r[0], r[1], r[2] or "")):
        if language in lang.family_of:
            by_language[language] += [(doc, s) for _, _, s in prose.sentences(text) if prose.letters(s) >= OWN_LETTERS]
    rng = np.random.default_rng(seed)
    rows: list[tuple[int, str, str]] = []
    for language, own in sorted(by_language.items()):
        chosen = rng.permutation(len(own))[:TRAIN_SENTENCES]
        rows += [(own[i][0], language, own[i][1]) for i in sorted(chosen)]
    seeds = [(-1, x, s) for x, text in SEEDS.items() if x in lang.family_of for s in prose._SENTENCE.split(text) if s]
    rows += seeds
    # Exports often lack marks, so every marked sentence is also learned without.
    rows += [(d, x, plain(s)) for d, x, s in rows if plain(s) != s]
    first = Model(_fit([r[2] for r in rows], [r[1] for r in rows], lang, epochs=3), languages=lang)
    said, _ = first.predict([r[2] for r in rows])
    agree: dict[int, list[bool]] = defaultdict(list)
    for (doc, x, _), p in zip(rows, said):
        agree[doc].append(x == p)
    kept = [(d, x, s) for (d, x, s), p in zip(rows, said) if d < 0 or (x == p and sum(agree[d]) * 2 >= len(agree[d]))]
    held = rng.random(len(kept)) < 0.15
    model = Model(_fit([r[2] for r, h in zip(kept, held) if not h], [r[1] for r, h in zip(kept, held) if not h], lang), languages=lang)
    test = [r for r, h in zip(kept, held) if h]
    return Model(model.weights, _slope(model, test), lang) if len(test) > 200 else model


def _slope(model: Model, test: list[tuple[int, str, str]]) -> float:
    """The slope under which held-out sentences are least surprising."""
    best = (np.inf, model.slope)
    for slope in (1.0, 1.5, 2.0, 3.0, 4.0, 6.0):
        said, sure = Model(model.weights, slope, model.languages).predict([r[2] for r in test])
        right = np.array([p == r[1] for p, r in zip(said, test)])
        p = np.clip(np.where(right, sure, 1 - sure), 1e-3, 1)
        best = min(best, (float(-np.log(p).mean()), slope))
    return best[1]


def labelled_sample(docs: DataFrame, labels: DataFrame, train_docs: int, lang: Languages = DEFAULT) -> list[tuple[int, str, str]]:
    """About `train_docs` documents of each language by its label, none longer than `TRAIN_CHARS`, chosen by a hash of the id.

    Rates come from counts over all documents, so the choice is a filter, without order or limit. labels: `label,
    lang_code`, a fixed table of spellings.
    """
    names = {r.label: r.lang_code for r in labels.where("label is not null and lang_code is not null").collect()}
    lang.check(names.values())
    known = docs.where(F.col("lang").isin(list(names)) & F.coalesce(F.length("text").between(MIN_LETTERS, TRAIN_CHARS), F.lit(False)))
    per_label = known.groupBy("lang").count().collect()
    total: dict[str, int] = defaultdict(int)
    for r in per_label:
        total[names[r["lang"]]] += r["count"]
    rate = {r["lang"]: min(1_000_000, int(1_000_000 * train_docs / total[names[r["lang"]]]) + 1) for r in per_label}
    if not rate:
        return []
    lot = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("langid")), F.lit(1_000_000))
    bound = F.coalesce(*[F.when(F.col("lang") == k, F.lit(v)) for k, v in sorted(rate.items())])
    return [(r.doc_id if r.doc_id is not None else -2, names[r.lang], r.text) for r in known.where(lot < bound).select("doc_id", "lang", "text").collect()]


@lru_cache(maxsize=None)
def _apart(language: str, main: str):
    """Letters that show `language` beside `main` by their script; none if both are written in the same ones."""
    scripts = SCRIPTS.get(language, set()) - SCRIPTS.get(main, set())
    return regex.compile("|".join(rf"\p{{{x}}}" for x in sorted(scripts))) if scripts else None


def _brings_in(sentence: str, letters: int, language: str, main: str) -> bool:
    """Whether one sure sentence is enough for its language to count beside the main one. Chinese and Japanese say more in a letter."""
    least = OWN_LETTERS if {language, main} <= {"ja", "zh"} else OTHER_LETTERS
    return letters >= least or bool((own := _apart(language, main)) and len(own.findall(sentence)) >= SCRIPT_LETTERS)


def decide(sentences: list[tuple[int, str, str]], said: list[str], sure: np.ndarray) -> tuple[dict[str, tuple[int, float]], list[tuple[int, str, float, int]]]:
    """Languages of one document with letters and confidence, and its segments `(block, language, confidence, letters)`.

    Sentences that are long and sure enough speak for themselves. The language with most letters is the
    document's; another one counts if a sentence of it is sure and long enough for its script to bring it in.
    All others follow their block, or else the document.
    """
    size = [prose.letters(s) for _, _, s in sentences]
    own: dict[str, float] = defaultdict(float)
    for n, x, p in zip(size, said, sure):
        if n >= OWN_LETTERS and p >= OWN_CONFIDENCE:
            own[x] += n
    if not own:
        for n, x, p in zip(size, said, sure):
            own[x] += n * p
    main = max(own, key=lambda x: (own[x], x))
    brings = [p >= OTHER_CONFIDENCE and _brings_in(s, n, x, main) for (_, _, s), n, x, p in zip(sentences, size, said, sure)]
    allowed = {main} | {x for x, yes in zip(said, brings) if yes}
    block: dict[int, dict[str, float]] = defaultdict(lambda: defaultdict(float))
    for (b, _, _), n, x, p in zip(sentences, size, said, sure):
        if x in allowed:
            block[b][x] += n * p
    out: dict[str, list[float]] = defaultdict(lambda: [0, 0.0])
    segments: list[list] = []
    for (b, _, _), n, x, p, alone in zip(sentences, size, said, sure, brings):
        strong = (x == main and p >= OWN_CONFIDENCE) or alone
        if not strong:
            x, p = max(block[b], key=lambda y: (block[b][y], y)) if block[b] else main, min(p, 0.5)
        out[x][0] += n
        out[x][1] += n * p
        if segments and segments[-1][0] == b and segments[-1][1] == x:
            segments[-1][2] += n * p
            segments[-1][3] += n
        else:
            segments.append([b, x, n * p, n])
    return {x: (int(n), c / max(n, 1)) for x, (n, c) in out.items()}, [(b, x, c / max(n, 1), n) for b, x, c, n in segments]


FOUND = "doc_id bigint, lang string, languages array<struct<language:string,letters:int,confidence:double>>, segments array<struct<block:int,language:string,confidence:double,letters:int>>"


def _detected(model_bytes):
    kind = pa.list_(pa.struct([("language", pa.string()), ("letters", pa.int32()), ("confidence", pa.float64())]))
    part = pa.list_(pa.struct([("block", pa.int32()), ("language", pa.string()), ("confidence", pa.float64()), ("letters", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_bytes.value
        for batch in batches:
            per_doc = [prose.sentences(t) for t in batch.column(2).to_pylist()]
            said, sure = model.predict([s for d in per_doc for _, _, s in d])
            languages, segments, at = [], [], 0
            for d in per_doc:
                n = len(d)
                if sum(prose.letters(s) for _, _, s in d) < MIN_LETTERS:
                    languages.append([])
                    segments.append([])
                else:
                    found, parts = decide(d, said[at : at + n], sure[at : at + n])
                    languages.append([{"language": x, "letters": k, "confidence": c} for x, (k, c) in sorted(found.items())])
                    segments.append([{"block": b, "language": x, "confidence": c, "letters": k} for b, x, c, k in parts])
                at += n
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(languages, kind), pa.array(segments, part)], names=["doc_id", "lang", "languages", "segments"])

    return run


_TRAINED: dict[tuple, str] = {}


def model_for(docs: DataFrame, labels: DataFrame, path: str, train_docs: int = TRAIN_DOCS, lang: Languages = DEFAULT) -> Model:
    """The model for the documents at `path`: trained once per application and state of that table, and kept in the shared folder."""
    spark = docs.sparkSession
    key = (spark.sparkContext.applicationId, path, table_state(spark, path), train_docs, lang)
    if not written(spark, _TRAINED.get(key)):
        where = shared_dir(spark, "languages")
        train(labelled_sample(docs, labels, train_docs, lang), lang=lang).save(spark, where)
        _TRAINED[key] = where
    return Model.load(spark, _TRAINED[key])


def detect(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS, model: Model | None = None, lang: Languages = DEFAULT) -> DataFrame:
    """`FOUND` for each row of `docs(doc_id, text, lang)`: its languages, and its segments in order."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "lang", "text")
    model = model or train(labelled_sample(docs, labels, train_docs, lang), lang=lang)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a matrix of fixed size
    return docs.mapInArrow(_detected(shared), FOUND)


def wrong_labels(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS, model: Model | None = None, lang: Languages = DEFAULT) -> DataFrame:
    """`(doc_id, language)`: the languages of each document whose label is missing or wrong, or that mixes languages."""
    names = {r.label: r.lang_code for r in labels.where("label is not null and lang_code is not null").collect()}
    (model.languages if model else lang).check(names.values())
    code = F.coalesce(*[F.when(F.col("lang").isin([k for k, v in names.items() if v == x]), F.lit(x)) for x in sorted(set(names.values()))], F.lit(None).cast("string")) if names else F.lit(None).cast("string")
    found = detect(docs, labels, train_docs, model, lang).where(F.size("languages") > 0)
    case = code.isNull() | (F.size("languages") > 1) | (F.col("languages")[0]["language"] != code)
    return found.where(case).select("doc_id", F.explode("languages.language").alias("language")).distinct()
