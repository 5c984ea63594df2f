"""Responses as sequences of clauses with features, and the field that labels them.

A clause is a block of code between blank lines or code fences, or a sentence of
what is said beside it, as prose or as comments. What a clause is shows in itself
only in part: most blocks of a program would do in two languages, and "Please ask
a maintainer." is a refusal or not by what stands before it. Features are of the
clause alone, and the field's moves from label to label carry the rest.

What refusals, advice and talk look like is learnt: hashed words and pairs of words
of a clause have weights of their own. The field is fitted to TRAINING_ROWS
responses that are put together here from phrases and programs of many kinds, with
the labels they were made from; no corpus text takes part in it.
"""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

from codekiln.llm.crf import Field, decode, fit
from codekiln.llm.sentences import sentences
from codekiln.llm.syntax import first_error

ANSWER, REFUSAL, ECHO, FOREIGN, UNFINISHED = range(5)
LABELS = ["answer", "refusal", "echo", "foreign", "unfinished"]
#: The documented bound on the labelled sample that the field is fitted to.
TRAINING_ROWS = 3300
#: Words are hashed to as many weights.
_HASHED = 1024

# Words that show a programming language when they stand alone.
_SHOWS = {
    "cpp": set("#include int void long double float unsigned namespace std; struct bool char auto size_t cout << endl; template nullptr const& int* string".split()),
    "javascript": set("function const let var => === !== async await typeof undefined".split()),
    "python": set("def import elif None True False self pass __name__ try: except else: lambda".split()),
    "shell": set("fi then esac done echo #!/bin/sh #!/bin/bash [[ ]]".split()),
}
_NAMES = list(_SHOWS)
_SHOWN_BY = {w: k for k, own in enumerate(_SHOWS.values()) for w in own}
_OTHER_SCRIPT = re.compile("[Ѐ-ӿ֐-ۿऀ-෿฀-๿぀-ヿ㐀-鿿가-힯]")
_PARTS = re.compile(r"\n[ \t\r]*\n|^[ \t]*(?:```|~~~)[^\n]*$", re.M)
_COMMENT_LINE = re.compile(r"\s*(?://|/\*|\*|#(?!\s*(?:include|define|if|ifdef|ifndef|else|elif|endif|pragma|undef|!)\b|!))")
_COMMENT_SIGNS = re.compile(r"^\s*(?://+|/\*+|\*+/?|#+)|\*+/\s*$", re.M)
_CODE_LINE = re.compile(r"[{};][ \t\r]*$|^\s*(?://|/\*)", re.M)
_SIGNS = str.maketrans("", "", ";{}()=[]<>")
_SQUEEZE = {
    "python": re.compile(r'"""(?:[^"\\]|\\.|"(?!""))*"""|\'\'\'(?:[^\'\\]|\\.|\'(?!\'\'))*\'\'\'|"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\'|#[^\n]*|[^\s"\'#]+|["\']', re.S),
    "": re.compile(r'"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\'|`(?:[^`\\]|\\.)*`|//[^\n]*|/\*(?:[^*]|\*(?!/))*(?:\*/|\Z)|[^\s"\'`/]+|["\'`/]', re.S),
}
_AFTERTHOUGHT = re.compile(r"(?:\s|//|#|\.{3}|…|\[\.{3}\]|\[truncated\]|<truncated>|\(truncated\))+\Z")


def _counts(text: str) -> np.ndarray:
    """How much of the text shows each of _NAMES."""
    counts = [0, 0, 0, 0]
    for w in text.split():
        if w in _SHOWN_BY:
            counts[_SHOWN_BY[w]] += 1
    cpp, javascript, python, shell = counts
    javascript += text.count("console.log(") + text.count("require(") + text.count("module.exports")
    python += text.count(":\n") + text.count("print(") + text.count("self.") - text.count(";\n") - text.count("{\n")
    cpp += text.count("std::") + text.count("vector<")
    return np.array([cpp, javascript, python, shell])


def _evidence(text: str, counts: np.ndarray | None = None) -> tuple[str, int]:
    """cpp, javascript, python or shell and by how much it leads; "braces" for either of the first two, or "", with 0 where nothing shows it."""
    found = (_counts(text) if counts is None else counts).tolist()
    if not (text.startswith("#!") or found[3] and "then" in text.split()):
        found[3] = 0
    else:
        found[3] *= 2
    order = sorted(found)
    if order[-1] > max(0, order[-2]):
        return _NAMES[found.index(order[-1])], order[-1] - max(0, order[-2])
    return ("braces" if ";\n" in text or "{\n" in text or text.rstrip().endswith((";", "}")) else ""), 0


def code_language(text: str) -> str:
    """The language that a program shows; see _evidence."""
    return _evidence(text)[0]


def other_code(prompt: str, response: str) -> bool:
    """Whether two languages as code_language names them differ for certain."""
    return bool(prompt and response) and prompt != response and not ("braces" in (prompt, response) and {prompt, response} & {"cpp", "javascript"})


def squeezed(text: str, language: str) -> str:
    """The text without white space and comments; those within strings stay, but for white space."""
    parts = _SQUEEZE["python" if language == "python" else ""].findall(text)
    kept = [p for p in parts if not (p.startswith("#") if language == "python" else p.startswith(("//", "/*")))]
    return "".join("".join(kept).split())


@dataclass(frozen=True)
class Clause:
    kind: str
    text: str


def clauses_of(text: str) -> list[Clause]:
    """Blocks of the response: code, comment or prose."""
    out = []
    for part in _PARTS.split(text.replace("\r\n", "\n")):
        if not part or part.isspace():
            continue
        if _COMMENT_LINE.match(part) and _all_comments(part):
            kind = "comment"
        else:
            words = len(part.split())
            signs = len(part) - len(part.translate(_SIGNS))
            lines = part.count("\n") + 1
            wordy = not part.lstrip("\n")[0].isspace() and words >= 3 * lines or _OTHER_SCRIPT.search(part) is not None
            kind = "prose" if signs <= 0.34 * words + 1 and wordy and part.rstrip()[-1] in ".:!?。！？；…)'\"”’" or (signs == 0 and words >= 4 and lines == 1) else "code"
            if kind == "prose" and (_CODE_LINE.search(part) or signs > 2 and code_language(part) == "python" or re.match(r"\s*(?:def|class|if|for|while|import|from|return|#include)\b[^.!?]*[:>)\"']?\s*$", part)):
                kind = "code"
        out.extend([Clause(kind, part)] if kind == "code" else [Clause(kind, one) for one in _said(part)])
    return out


def _all_comments(part: str) -> bool:
    """Whether every line of the block is a comment or within one that the block opens with."""
    inside = part.lstrip().startswith("/*")
    for line in part.split("\n"):
        if not (inside or _COMMENT_LINE.match(line) or not line.strip()):
            return False
        inside = inside and "*/" not in line
    return True


def _said(part: str) -> list[str]:
    """The sentences of a block of prose or comments, without comment signs."""
    plain = _COMMENT_SIGNS.sub(" ", part).strip()
    plain = " ".join(plain.split())
    return [plain[a:b] for a, b in sentences(plain)] or [part]


def _ends_like(code: str, prompt: str) -> bool:
    """Whether both have the same last two lines that aren't blank, and the last is a whole one without indent."""
    ends = [[line.rstrip() for line in text.rstrip().split("\n")[-6:] if line.strip()][-2:] for text in (code, prompt)]
    last = ends[0][-1] if ends[0] else " "
    return not last[0].isspace() and last[-1] in "};)" and [x.strip() for x in ends[0]] == [x.strip() for x in ends[1]]


FEATURES = ["bias", "code", "comment", "prose", "some code", "no code", "first and said", "other script", "other language", "other language for sure", "same language", "echo", "last and open"]
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
_UNSPACED = re.compile("[\u0e00-\u0e7f\u3040-\u30ff\u3400-\u9fff]")


def hashed_words(text: str) -> np.ndarray:
    """Places of a clause's words, their beginnings and pairs among the hashed features; of two signs in a row in scripts without spaces."""
    words = [w.lower().replace("’", "'") for w in _WORD.findall(text)]
    seen = {*words, *(w[:5] + "-" for w in words if len(w) > 5), *map(" ".join, zip(words, words[1:], strict=False))}
    for w in words:
        if _UNSPACED.search(w):
            seen |= {w[k : k + 2] for k in range(len(w) - 1)}
    return np.unique([zlib.crc32(w.encode()) % _HASHED for w in seen]).astype(int)


@dataclass(frozen=True)
class Described:
    """rows: a row of FEATURES for each clause. words: places among the hashed features, of what is said where there is no code. spoken: the prompt's language."""

    clauses: list[Clause]
    rows: np.ndarray
    words: list[np.ndarray]
    spoken: str

    def scores(self, field: Field) -> np.ndarray:
        """clauses x labels."""
        out = self.rows @ field.weights[: len(FEATURES)]
        for k, own in enumerate(self.words):
            if len(own):
                out[k] += field.weights[len(FEATURES) + own].sum(axis=0) / np.sqrt(len(own))
        return out

    def wide(self) -> np.ndarray:
        """All features as one array, for fitting."""
        out = np.zeros((len(self.rows), len(FEATURES) + _HASHED), dtype=np.float32)
        out[:, : len(FEATURES)] = self.rows
        for k, own in enumerate(self.words):
            if len(own):
                out[k, len(FEATURES) + own] = 1 / np.sqrt(len(own))
        return out


def described(prompt: str, response: str) -> Described:
    """The clauses of a response and their features."""
    clauses = clauses_of(response)
    code = "\n".join(c.text for c in clauses if c.kind == "code")
    counts = [_counts(c.text) if c.kind == "code" else None for c in clauses]
    spoken = code_language(prompt)
    written = _evidence(code, sum(x for x in counts if x is not None))[0] if code else ""
    source = squeezed(prompt, spoken) if code else ""
    opened = False
    if code and written in ("cpp", "javascript", "python", "braces"):
        language = written if written != "braces" else spoken if spoken in ("cpp", "javascript") else "cpp"
        rest = _AFTERTHOUGHT.sub("", code)
        opened = (first_error(code, language) or ("", ""))[1] == "end" or (len(rest) < len(code.rstrip()) and (first_error(rest + "\n", language) or ("", ""))[1] == "end")
    if opened and _ends_like(code, prompt):
        opened = False  # the program's end is there; what is open was left out before it
    rows, words = np.zeros((len(clauses), len(FEATURES))), []
    last_code = max((k for k, c in enumerate(clauses) if c.kind == "code"), default=-1)
    bare = last_code < 0
    for k, c in enumerate(clauses):
        speech = c.kind != "code"
        foreign = speech and not c.text.isascii() and len(_OTHER_SCRIPT.findall(c.text)) > 0.2 * sum(map(len, _WORD.findall(c.text)))
        own, lead = ("", 0) if speech else _evidence(c.text, counts[k])
        differs = other_code(spoken, own)
        body = "" if speech else squeezed(c.text, spoken)
        rows[k] = [
            1,
            not speech,
            c.kind == "comment",
            c.kind == "prose",
            not bare,
            bare,
            k == 0 and speech,
            foreign,
            differs,
            differs and lead > 2,
            bool(own) and own == spoken and lead > 0,
            bool(body) and body in source,
            opened and k == last_code,
        ]
        words.append(hashed_words(c.text) if speech and bare else np.empty(0, dtype=int))
    return Described(clauses, rows, words, spoken)


# --- The training sample -------------------------------------------------------

# A refusal is an excuse, what can't be done, to what, and perhaps more; the parts of a language are combined freely.
_REFUSALS = {
    "en": (
        ["I'm sorry, but", "Sorry,", "Sorry —", "Apologies, but", "Unfortunately", "Unfortunately,", "I am afraid", "I regret that", "Hmm.", "Thanks for the {x} code.", "Regrettably,", "As an assistant,", "As an automated reviewer,", "As a code assistant", "", "", "", ""],
        ["I can't", "I cannot", "I can not", "I could not", "I am unable to", "I won't", "I will not", "I'm not able to", "I am not permitted to", "I am not allowed to", "we cannot", "we are unable to", "I must decline to", "I have to decline to", "I do not feel comfortable to", "my guidelines do not allow me to", "my policy forbids me to", "it would not be appropriate for me to", "it is not possible for me to", "I refuse to", "I would rather not", "I am not willing to", "I shouldn't", "nobody here may", "I'm not going to", "It is not possible for me to", "However, we cannot", "we can not"],
        ["rewrite", "optimize", "optimise", "improve", "change", "help with", "process", "transform", "modify", "suggest changes to", "give you a better version of", "comply with", "edit", "touch", "provide a faster", "speed up", "work on", "continue with", "assist with", "share a version of", "produce"],
        ["this {x} code", "the {x} module", "this request", "what you pasted", "the {x} routine", "this program", "it", "the {x} listing you sent", "the {x} section", "this {x} record", "the {x} handling", "your file", "changes here"],
        ["", "", "", " without more context", " at this time", ", since it looks like proprietary code", " without the {x} header", " because the {x} rules say so", " right now"],
    ),
    "de": (["Es tut mir leid,", "Leider", "Entschuldigung,", "Ich bedauere,", ""], ["kann ich", "darf ich", "ich kann", "ich darf", "ich möchte", "können wir"], ["den Code für {x}", "dieses Programm", "das Modul {x}", "diese Anfrage", "Ihren Text"], ["nicht"], [" umschreiben", " verbessern", " optimieren", " ändern", " bearbeiten", " beantworten"]),
    "fr": (["Désolé,", "Je suis désolé, mais", "Malheureusement,", "Je regrette,", ""], ["je ne peux pas", "je ne suis pas en mesure de", "il m'est impossible de", "nous ne pouvons pas", "je refuse de", "je ne souhaite pas"], ["réécrire", "améliorer", "optimiser", "modifier", "traiter", "changer"], ["le module {x}", "ce code", "ce programme", "cette demande", "la fonction {x}"], [""]),
    "es": (["Lo siento,", "Lo lamento, pero", "Lamentablemente", "Desafortunadamente,", ""], ["no puedo", "no me es posible", "no podemos", "no se puede", "no soy capaz de", "me niego a"], ["optimizar", "mejorar", "reescribir", "cambiar", "modificar", "procesar"], ["el código de {x}", "este programa", "el módulo {x}", "esta petición", "lo que envió"], [""]),
    "ru": (["К сожалению,", "Извините,", "Простите, но", ""], ["я не могу", "мы не можем", "я не буду", "мне нельзя", "невозможно", "я отказываюсь"], ["изменить", "переписать", "улучшить", "оптимизировать", "обработать"], ["модуль {x}", "этот код", "эту программу", "этот запрос", "код {x}"], [""]),
    "ja": (["申し訳ありませんが、", "すみませんが、", "残念ながら、", ""], ["{x} のコードを", "このプログラムを", "このモジュールは", "ご依頼の変更は", "この内容を"], ["書き換えること", "最適化すること", "変更すること", "改善すること"], ["は"], ["できません", "いたしかねます", "お断りします", "できないのです"]),
    "zh": (["抱歉，", "对不起，", "很遗憾，", ""], ["我不能", "我无法", "我们不能", "不可以", "我拒绝"], ["优化", "改写", "重写", "修改", "处理"], ["{x} 的代码", "这段代码", "这个程序", "这个请求", "{x} 模块"], [""]),
    "hi": (["क्षमा करें,", "माफ़ कीजिए,", "खेद है,", ""], ["मैं"], ["{x} का कोड", "यह कोड", "इस प्रोग्राम को", "यह अनुरोध"], ["नहीं"], [" बदल सकता", " लिख सकता", " सुधार सकता", " कर सकता"]),
    "th": (["ขออภัย", "ขอโทษ", ""], ["ฉันไม่สามารถ", "ผมไม่สามารถ", "เราไม่สามารถ", "ขอปฏิเสธที่จะ"], ["แก้", "ปรับปรุง", "เขียนใหม่"], ["โค้ดนี้", "โปรแกรม {x}", "คำขอนี้"], ["ได้", ""]),
    "ar": (["عذرا،", "آسف،", "للأسف،", ""], ["لا أستطيع", "لا يمكنني", "لن أتمكن من", "أرفض"], ["تعديل", "تحسين", "إعادة كتابة"], ["هذا الكود", "الوحدة {x}", "هذا البرنامج"], [""]),
    "pt": (["Desculpe, mas", "Infelizmente", ""], ["não posso", "não consigo", "não me é possível"], ["melhorar", "reescrever", "otimizar", "alterar"], ["o código de {x}", "este programa", "este pedido"], [""]),
    "it": (["Mi dispiace,", "Purtroppo", ""], ["non posso", "non sono in grado di", "non mi è possibile"], ["migliorare", "riscrivere", "ottimizzare", "modificare"], ["il codice di {x}", "questo programma", "questa richiesta"], [""]),
    "ko": (["죄송하지만", "유감스럽게도", ""], ["{x} 코드를", "이 프로그램을", "이 요청을"], ["수정할 수", "최적화할 수", "다시 쓸 수"], [""], ["없습니다"]),
}
_WHOLE_REFUSALS = ["This request was refused.", "This request can't be completed; the {x} policy forbids edits.", "Changing this {x} would not be right.", "That would be against my rules.", "No. The {x} section is off limits.", "I can’t comply with this request!"]
_FOLLOW_UPS = ["Please ask the author of the {x}.", "Please ask a maintainer.", "Please contact whoever owns the {x}.", "Is there anything else you need?", "Is there something else I can do?", "I can explain the {x} instead.", "Thank you for your patience.", "Let me know how to go on."]
_TALK = ["Here is a quicker way to do it:", "Sure! The loop over the {x} is gone.", "I could not make it any faster than this, sorry for the wait:", "The result stays the same.", "This version uses a table for the {x}."]
_ADVICE = [
    "The loop over the {x} could stop earlier.",
    "Keep the {x} in a table and look it up.",
    "A faster version would sort the {x} first.",
    "Change the {x} to a reference here.",
    "The inner loop is not needed, so the cost falls by half.",
    "It is better to store the size of the {x} before the loop.",
    "This function reads the array twice, which can be avoided.",
    "You can replace the {x} by a running sum.",
    "The {x} is copied on every call and should not be.",
    "Use a faster {x} here.",
    "Move the {x} out of the loop to speed up the program.",
    "To improve this code, store the {x} once.",
    "Nothing has to change, the {x} is fast already.",
    "I would rewrite the {x} as one pass.",
    "You can optimize the {x} with a table.",
    "Process the {x} in blocks and modify it in place.",
]
_FOREIGN = {
    "de": ["Die Schleife über {x} läuft zu oft und sollte früher enden.", "Die innere Schleife ist überflüssig.", "Man sollte die Größe vor der Schleife in {x} ablegen.", "Damit sinken die Kosten um die Hälfte.", "Die Funktion {x} durchläuft das Feld zweimal.", "Ein Verweis auf {x} spart die Kopie.", "Die Funktion ist schon schnell.", "Man kann {x} ändern und den Code so verbessern.", "An {x} sollte man nichts umschreiben."],
    "fr": ["La boucle sur {x} est inutile et la taille peut être gardée avant.", "La boucle interne est inutile.", "La fonction {x} parcourt le tableau deux fois.", "Le coût baisse alors de moitié.", "Il vaut mieux garder la taille dans {x} avant la boucle.", "Une référence à {x} évite la copie.", "On peut améliorer ce code en modifiant {x}.", "La fonction est déjà rapide et il ne faut rien changer."],
    "es": ["El bucle de {x} se repite y conviene guardar el resultado con antelación.", "El bucle interior sobra por completo.", "La función {x} recorre el vector dos veces.", "Así el coste baja a la mitad.", "Conviene guardar el tamaño en {x} antes del bucle.", "Una referencia a {x} evita la copia.", "Se puede mejorar este programa al cambiar {x}.", "La función ya es rápida y no hay que modificar nada."],
    "ru": ["Цикл по {x} лишний, его можно убрать.", "Функция {x} обходит массив дважды.", "Тогда время падает вдвое.", "Размер стоит сохранить в {x} перед циклом.", "Внутренний цикл не нужен.", "Этот код можно улучшить, если изменить {x}.", "Функция уже быстрая, менять ничего не нужно.", "Этот цикл и так достаточно быстрый.", "В этой программе хватит {x}."],
    "ja": ["{x} のループは一回で十分です。", "関数 {x} は配列を二回走査します。", "内側のループは不要です。", "ループの前に長さを {x} に保存してください。", "これで時間が半分になります。", "{x} を変更すればこのコードを改善できます。", "関数はもう速いので変更は不要です。", "この処理は {x} で十分です。", "このプログラムは配列を {x} に持つと速くなります。", "このループには {x} が向いています。"],
    "zh": ["{x} 的循环可以合并成一次。", "函数 {x} 遍历了数组两次。", "内层循环是多余的。", "应当在循环之前把长度存入 {x} 。", "这样时间会减半。", "修改 {x} 就可以优化这段代码。", "函数已经很快，不需要改写。", "这个循环用 {x} 就足够了。", "这段代码把数组放在 {x} 中会更快。"],
    "hi": ["{x} का लूप एक बार ही चलना चाहिए।", "भीतर का लूप ज़रूरी है ही नहीं।", "आकार को {x} में रखिए।", "{x} बदलने से यह कोड सुधर सकता है।"],
    "th": ["ลูปของ {x} ซ้ำซ้อน", "ควรเก็บขนาดไว้ใน {x} ก่อนลูป", "ฟังก์ชัน {x} อ่านอาร์เรย์สองครั้ง", "แก้ {x} แล้วโค้ดจะเร็วขึ้น"],
    "ar": ["حلقة {x} زائدة ويمكن حذفها.", "تقرأ الدالة {x} المصفوفة مرتين.", "من الأفضل حفظ الحجم في {x} قبل الحلقة.", "يمكن تحسين هذا الكود بتعديل {x}."],
    "pt": ["O laço sobre {x} é desnecessário.", "A função {x} percorre o vetor duas vezes.", "É melhor guardar o tamanho em {x} antes do laço.", "Pode-se melhorar este programa ao alterar {x}."],
    "it": ["Il ciclo su {x} è inutile.", "La funzione {x} scorre il vettore due volte.", "Conviene salvare la dimensione in {x} prima del ciclo.", "Si può migliorare questo programma se si cambia {x}."],
    "nl": ["De lus over {x} is overbodig.", "De functie {x} doorloopt de rij twee keer.", "Bewaar de grootte in {x} voor de lus."],
}
_REMARKS = ["keep {x} sorted", "sorry, {x} cannot be inlined", "not allowed to be empty: {x}", "сначала {x}", "déjà trié par {x}", "先に {x} を数える"]
# Lines of data and of other texts that are no program, a kind on each row.
_DATA = [
    '  "{x}": {n},|  "{y}": {"{z}": {n}, "{x}": [{n}, {n}]},',
    '<tr><td>{x}</td><td>{n}</td></tr>|<div class="{y}">{z}</div>|<li>{x} {y}</li>',
    "-    {x} = {n};|+    {x} = {n};|     {y}({z});|@@ -{n},{n} +{n},{n} @@",
    "{x},{n},{y}|{z},{n},{x}",
    "{n} {x} started|{n} {y} took {n} ms|[{n}] error in {z}",
    "{x}: {n}|  {y}: {z}|  - {x}",
    "select {x}, {y} from {z} where {x} > {n};|join {y} on {z}.id = {n}",
    "mov {x}, {n}|add {y}, {z}|jmp {x}",
]
# Blocks that show no language, or that could be of two.
_PLAIN = {
    "cpp": ["for ({x} = 0; {x} < {y}; {x}++) {\n    {z} = {z} + {x};\n}", "if ({x} > {y}) {\n    {z} = {x};\n}", "{x} = {y} * {z};"],
    "javascript": ["for ({x} = 0; {x} < {y}; {x}++) {\n    {z} = {z} + {x};\n}", "if ({x} > {y}) {\n    {z} = {x};\n}", "{x} = {y} * {z};"],
    "python": ["{x} = {y} * {z}", "{x} = [{y}, {z}]\n{y} = {x}[0]", "{x} += {y}"],
}
_PROGRAMS = {
    "cpp": ["#include <vector>\n#include <string>\nusing namespace std;", "int {x}(int {y}) {\n    // {r}\n    int {z} = 0;\n    for (int i = 0; i < {y}; i++) {\n        {z} += i * {y};\n    }\n    return {z};\n}", "void {x}(const vector<int>& {y}) {\n    double {z} = 1.5;\n    cout << {y}[0] << {z} << endl;\n}"],
    "javascript": ['const {y} = require("fs");', "function {x}({y}) {\n  // {r}\n  let {z} = [];\n  for (const k of {y}) {\n    {z}.push(k === 3);\n  }\n  return {z};\n}", "module.exports = { {x}, {y} };"],
    "python": ["import math\nimport sys", "def {x}({y}, {z}=None):\n    # {r}\n    if {z} is None:\n        {z} = [len({y})]\n    return [k * 2 for k in {y}]", 'if __name__ == "__main__":\n    print({x}(3))'],
}


def _training_sample(seed: int = 11, rows: int = TRAINING_ROWS, without: str = "") -> tuple[list[Described], list[np.ndarray]]:
    """Described responses and the labels of their clauses; `without` leaves out the refusals of a language."""
    rng = random.Random(seed)
    languages = [x for x in _REFUSALS if x != without]

    def name() -> str:
        return "".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(3)) + rng.choice(["", "", "_of", "7"])

    def filled(text: str) -> str:
        for k in "xyz":
            text = text.replace("{" + k + "}", name())
        while "{n}" in text:
            text = text.replace("{n}", str(rng.randrange(10 ** rng.randint(1, 6))), 1)
        return text.replace("{r}", rng.choice(_REMARKS).replace("{x}", name()))

    def refusal() -> str:
        language = "en" if rng.random() < 0.35 and "en" in languages else rng.choice(languages)
        if language == "en" and rng.random() < 0.12:
            return filled(rng.choice(_WHOLE_REFUSALS))
        text = " ".join(p for p in map(rng.choice, _REFUSALS[language]) if p)
        text = re.sub(r"(?<=[\u3040-\u9fff\u0e00-\u0e7f，、]) (?=[\u3040-\u9fff\u0e00-\u0e7f])| (?=,)", "", text).replace("  ", " ").strip()
        end = "。" if language in ("ja", "zh") else "।" if language == "hi" else rng.choice("..!")
        return filled(text[0].upper() + text[1:] if rng.random() < 0.8 else text) + end

    def program(language: str) -> list[str]:
        head, body, last = _PROGRAMS[language]
        whole = [filled(head), *[filled(body if rng.random() < 0.7 else last if rng.random() < 0.5 else rng.choice(_PLAIN[language])) for _ in range(rng.randint(1, 5))], filled(last)]
        return ["\n".join(whole)] if rng.random() < 0.25 else whole

    def commented(text: str, language: str) -> str:
        return ("# " if language == "python" else "// ") + text

    found, ys = [], []
    for row in range(rows):
        language = rng.choice(sorted(_PROGRAMS))
        prompt = program(language)
        kind = row % 11
        talk = [(filled(rng.choice(_TALK)), ANSWER)] if rng.random() < 0.4 else []
        if kind in (0, 1, 9):
            blocks = [(refusal(), REFUSAL)] + [(filled(rng.choice(_FOLLOW_UPS)) if rng.random() < 0.6 else refusal(), REFUSAL)] * rng.randint(0, 1)
            if kind == 1:
                blocks = [(commented(t, language), k) for t, k in blocks]
        elif kind == 2:
            blocks = talk + [(b, FOREIGN) for b in program(rng.choice([x for x in _PROGRAMS if x != language]))]
        elif kind in (3, 7):
            blocks = [(filled(t), FOREIGN) for t in rng.choices(_FOREIGN[rng.choice(sorted(_FOREIGN))], k=rng.randint(1, 3))]
        elif kind == 4:
            blocks = [(b, ECHO) for b in prompt]
        elif kind == 5:
            whole, label = (program(language), ANSWER) if rng.random() < 0.5 else (prompt, ECHO)
            cut = filled(_PROGRAMS[language][1]) if label == ANSWER else whole[-1]
            blocks = talk + [(b, label) for b in whole[:-1]] + [(cut[: max(cut.rfind("("), cut.rfind("{")) + 1], UNFINISHED)]
        elif kind == 6:
            blocks = talk + [(b, ECHO if b in prompt else ANSWER) for b in [prompt[0], *program(language)]]
        elif kind == 10:
            lines = rng.choice(_DATA).split("|")
            blocks = talk + [("\n".join(filled(rng.choice(lines)) for _ in range(rng.randint(2, 12))), ANSWER) for _ in range(rng.randint(1, 3))]
        elif rng.random() < 0.5:
            blocks = [(filled(rng.choice(_ADVICE)), ANSWER) for _ in range(rng.randint(1, 3))] + [(filled(rng.choice(_FOLLOW_UPS)), ANSWER)] * (rng.random() < 0.3)
        else:
            blocks = talk + [(b, ANSWER) for b in program(language)] + talk
        made = described("\n\n".join(prompt) + "\n", "\n\n".join(b for b, _ in blocks) + "\n" * (kind != 5))
        labels = _labels_of(made.clauses, blocks)
        if labels is not None:
            found.append(made)
            ys.append(labels)
    return found, ys


def _labels_of(clauses: list[Clause], blocks: list[tuple[str, int]]) -> np.ndarray | None:
    """The label of each clause from the block it was cut from; None if they can't be told apart."""
    labels, at = [], 0
    for c in clauses:
        inside = lambda k: all(word in blocks[k][0] for word in c.text.split()[:6])  # noqa: B023, E731
        while at < len(blocks) and not inside(at):
            at += 1
        if at == len(blocks):
            return None
        labels.append(blocks[at][1])
    return np.array(labels) if labels else None


@lru_cache
def trained_field(without: str = "") -> Field:
    found, labels = _training_sample(without=without)
    return fit([d.wide() for d in found], labels, len(LABELS))


def label_clauses(field: Field, responses: list[Described]) -> list[np.ndarray]:
    return decode(field, [d.scores(field) for d in responses])
