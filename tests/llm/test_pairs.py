import pytest

from veritide.llm.pairs import Judge, defects

Q = "Which accounts say that the donor import hides the shared mailbox during the annual drive?"
GOOD = "Two accounts describe the same failure. The donor import hides the shared mailbox (THEME-0014)."
CASES = [
    (Q, GOOD, None, []), (Q, "Four.", None, []), (Q, "The import hides it (THEME-0014, claim 0da2b86f7d66)", None, []), (Q, "It began in spring [0da2b86f7d66].", None, []), (Q, "I cannot say more than the claims do, but they are clear. It began in spring.", None, []),
    (Q, GOOD + " “El código de descuento bloquea sin aviso el crédito ya pagado.”", None, []), (Q, "No: the log says otherwise.", "n/a", []), (Q, "You ask: " + Q + " Two accounts describe the same failure.", None, []),
    *[(Q, a, d, ["empty"]) for a, d in ((None, None), ("", " "), ("...", None), ("N/A", "none"), ("​", ""), ('""', None), ("[]", "-"), ("null", None))],
    (Q, GOOD[:-12], None, ["truncated"]), (Q, "The bank file depends on the…", None, ["truncated"]), (Q, "Because:\n1)", None, ["truncated"]), (Q, "It began (in spring", None, ["truncated"]), (Q, "It began in spring, and", None, ["truncated"]), (Q, "It “began in spring.", None, ["truncated"]),
    (Q, "Good point. I'm not able to comment on that.", None, ["refusal"]), (Q, "", "The excerpts are silent about it.", ["refusal"]), (Q, "It is not possible for me to guess the cause.", None, ["refusal"]), (Q, "Nothing in the supplied evidence speaks to it.", None, ["refusal"]),
    ("Wie viele Kunden sagen, dass die Rechnung fehlt?", "Leider kann ich dazu nichts sagen.", None, ["refusal"]), ("¿Qué sabemos de la lista?", "Lo siento, no puedo responder con estos extractos.", None, ["refusal"]),
    (Q, Q, None, ["copy"]), (Q, "Question: " + Q.lower().rstrip("?"), None, ["copy"]), (Q, Q + "\n" + Q, None, ["copy"]), (Q, Q.replace("donor ", ""), None, ["copy"]), (Q, f'"{Q}"', None, ["copy"]),
    (Q, "Die Belege deuten auf eine Ursache. Das neue Postfach rundet die Tickets für mehrere Tage.", None, ["language"]), (Q, "会员部门重复计算了共用账户。", None, ["language"]), (Q, "Duas contas descrevem a mesma falha. A lista não coincide com a", None, ["truncated", "language"]),
    (Q, "Lo siento, no puedo decir nada sobre este punto.", None, ["refusal", "language"]), (None, GOOD, None, []), ("", "Die Belege deuten auf eine Ursache.", None, []),
]


@pytest.mark.parametrize("q,a,r,want", CASES)
def test_defects(q, a, r, want):
    assert Judge().defects(q, a, r) == want


def test_frame(spark):
    rows = [(i, q, a, r) for i, (q, a, r, _) in enumerate(CASES)] + [(0, *CASES[0][:3]), (999, Q, ("word " * 200_000).strip() + ".", None), (998, "x " * 30_000, "x " * 30_000, None)]
    df = spark.createDataFrame(rows, "rec_no long, q string, a string, r string")
    got = sorted(tuple(x) for x in defects(df, "rec_no", "q", "a", "r").collect())
    assert got == sorted([(i, d) for i, c in enumerate(CASES) for d in c[3]] + [(998, "copy")])
    assert defects(df.limit(0), "rec_no", "q", "a", "r").count() == 0


# Phrasings that are in no list above; a share of them may be missed.
HELD_OUT = """I am not going to answer that.|That's not something I can help with.|My guidelines do not allow me to discuss this.|We are not able to comment on individual accounts.|I'd rather not speculate about the cause.|I must decline to answer.|Sorry, but I won't be discussing that.|No comment.
Das darf ich nicht beantworten.|Meine Richtlinien erlauben das nicht.|Ich lehne es ab, darüber zu sprechen.|Es tut mir leid, aber dazu kann ich keine Auskunft geben.
Je ne répondrai pas à cette question.|Mes consignes m'empêchent d'en parler.|Je m'abstiens de tout commentaire.
No responderé a esa pregunta.|Mis directrices no me permiten hablar de ello.|No estoy autorizada para comentar eso.
Não responderei a essa pergunta.|As minhas diretrizes não permitem falar disso.|Não estou autorizado a comentar.
Non posso rispondere a questa domanda.|Mi dispiace, ma non sono in grado di commentare.|Preferisco non esprimermi su questo punto.
Ik kan deze vraag helaas niet beantwoorden.|Daar mag ik niets over zeggen.|Het spijt me, maar ik ga daar niet op in.
Я не имею права обсуждать это.|Мои правила не позволяют отвечать.|Извините, я отказываюсь отвечать.
عذرًا، لا أستطيع الإجابة عن هذا السؤال.|لا يمكنني التعليق على ذلك.|أفضل عدم الخوض في هذا الموضوع.
죄송하지만 이 질문에는 답변을 드릴 수 없습니다.|그 부분은 말씀드리기 어렵습니다.|도움을 드릴 수 없습니다.
क्षमा करें, मैं इस प्रश्न का उत्तर नहीं दे सकता।|मैं इस पर टिप्पणी नहीं कर सकती।|मुझे इस पर बोलने की अनुमति नहीं है।
ขออภัย ฉันไม่สามารถตอบคำถามนี้ได้|ขอไม่แสดงความคิดเห็นในเรื่องนี้|ผมไม่อาจให้ข้อมูลนั้นได้
Λυπάμαι, δεν μπορώ να απαντήσω σε αυτό.|Αδυνατώ να σχολιάσω.|Προτιμώ να μην πω τίποτα.
この質問に答えることはできません。|コメントは差し控えます。|その件についての回答はできかねます。
抱歉，我无法讨论这个问题。|对此我不予置评，也不能提供更多。|我的准则不允许回答。"""
SOUND = """I can confirm that two accounts say so.|We could not find the invoice, so the import was repeated.|The import cannot match the shared mailbox.|Das Formular kann die Tickets nicht anzeigen.|Il ne manque pas de preuves dans ces extraits.|No hay dos cuentas iguales en la lista.|Non è la fattura, ma il modulo.|Het formulier toont de kaarten niet.|Импорт не может найти общий ящик.
لا تزال القائمة بدون الحساب المشترك.|가져오기가 공유 계정을 찾을 수 없습니다.|आयात साझा खाते को नहीं दिखाता।|รายชื่อไม่ตรงกับราคา|Η λίστα δεν δείχνει την τιμή.|名簿は入場券を表示しません。|名单不能显示门票。|I said that it works.|We have nothing but praise for it."""


def test_held_out_refusals():
    judge = Judge()
    said = [x for x in HELD_OUT.replace("\n", "|").split("|")]
    missed = [x for x in said if not judge.refused(x)]
    assert len(missed) <= 0.1 * len(said), missed
    assert [x for x in SOUND.replace("\n", "|").split("|") if judge.refused(x)] == []


def test_no_limit_of_length_or_number_of_openings():
    judge = Judge()
    assert judge.refused("Sorry. " * 9 + "I cannot answer that.")
    for n in (1, 20, 60):  # a long first sentence is looked at whole
        assert not judge.refused("Of course, " * n + "I cannot say more than the claims do.")
