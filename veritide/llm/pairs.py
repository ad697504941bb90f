"""Broken prompt-response pairs, by ordered rules; every rule that fires gives a defect.

1 empty      neither answer nor reason holds anything but punctuation, blanks, invisible characters or a stand-in
2 copy       the answer is the question again: same words but for a label, a repetition, case, punctuation or one word in twelve
3 refusal    the pair declines: a reason for declining is given, or the answer (without a polite opening) is a refusal
4 truncated  the answer ends in an open delimiter, dots, a comma, a dangling list mark, or without end mark or citation
5 language   script of the answer, or its function words outside quotations, belong to another language than the question's

A copy is neither truncated nor in another language; an empty pair has no other defect. Rows are independent: Arrow batches,
one pass, no shuffle.

Defined results: null answers and reasons count as not given; with a null or blank question there is neither copy nor
language; texts of any length are judged whole; repeated rows give their rows each; texts too short to tell their language
are never foreign.
"""
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

# Stand-ins for nothing.
NOTHING = """none|null|nil|nan|n/a|na|n.a|k.a|s/o|tbd|tba|todo|undefined|unknown|nothing|empty|blank|no answer|no response|not available|not applicable|
keine|keine antwort|nichts|leer|aucun|aucune|néant|vide|rien|ninguno|ninguna|nada|vacío|sin respuesta|nenhum|nenhuma|vazio|sem resposta|нет|なし|無し|无|空"""
# Polite openings before a refusal.
OPENINGS = r"""(?:good (?:point|question)|great question|thank you(?: for (?:the|your) question)?|thanks(?: for asking)?|i (?:looked|searched|went) through (?:all|the) excerpts|
i (?:have )?(?:read|checked) (?:all|the) (?:excerpts|claims)|sorry(?:,? but)?|i am (?:so |very |really )?sorry(?:,? but)?|i'm (?:so |very |really )?(?:sorry|afraid)(?:,? but| that)?|my apologies(?:,? but)?|i apologi[sz]e(?:,? but)?|regrettably|unfortunately|of course|certainly|
(?:es )?tut mir (?:sehr )?leid(?:,? aber)?|danke(?: für die frage)?|vielen dank(?: für die frage)?|gute frage|guter punkt|tut mir leid|leider|es tut mir leid|ich habe alle auszüge (?:gelesen|durchgesehen|geprüft)|
merci(?: pour (?:la|votre) question| de la question)?|bonne question|désolée?|je suis désolée?|malheureusement|j'ai (?:lu|parcouru|relu) tous les extraits|
gracias(?: por la pregunta)?|buena pregunta|buen punto|lo siento|lamentablemente|por desgracia|he (?:leído|revisado) todos los extractos|
obrigad[oa](?: pela pergunta)?|boa pergunta|bom ponto|lamento|infelizmente|desculpe|li todos os excertos|revi todos os excertos)\s*[.,!:;–—-]*\s*"""
# How an answer declines, by language (apostrophes straight, small letters).
REFUSALS = {
    "en": r"""(?:as an? (?:ai |language )?(?:assistant|model),? )?(?:unfortunately,? |sadly,? |sorry,? (?:but )?)?(?:
        i (?:can't|cannot|can not|could not|couldn't|won't|will not|would rather not|would prefer not to|must decline|have to decline|decline|refuse|am unable|am not able|am not in a position|am not comfortable|don't feel able|do not feel able|prefer not to|have no (?:information|evidence|basis|way))\b|
        i'm (?:unable|not able|not in a position|not comfortable|afraid i (?:can't|cannot))\b|
        it (?:is|would be|isn't|is not) (?:not )?(?:possible|im?possible|feasible) for me\b|
        (?:this|that|the|your) (?:question|request|topic|point)?\s*(?:falls|is|lies|goes) (?:beyond|outside)\b|
        (?:the (?:excerpts|store|claims|evidence|material|themes|archive)|nothing in the|no (?:retrieved |supplied )?(?:theme|claim|excerpt|evidence))\b.{0,40}?\b(?:silent|nothing|say nothing|do(?:es)? not (?:say|mention|cover|contain)|covers?|speaks? to|mentions?|addresses)\b|
        there (?:is|was) (?:not enough|no|insufficient|too little) (?:context|evidence|information)\b|
        (?:\S+ ){1,12}?does not appear in any (?:theme|claim|excerpt))""",
    "de": r"""(?:als assistent(?:in)?,? )?(?:leider )?(?:
        ich (?:kann|könnte|darf|werde|möchte|will|muss|bin)\b.{0,30}?\b(?:nicht|keine?|nichts|verzichten|ablehnen|außerstande|lieber)\b|
        (?:leider )?(?:kann|darf|werde|möchte|muss) ich\b.{0,40}?\b(?:nicht|keine?|nichts|verzichten|ablehnen)\b|
        es ist mir (?:leider )?(?:nicht|un)\s*möglich|es ist mir unmöglich|mir ist es (?:leider )?(?:nicht|un)\s*möglich|
        dazu (?:liegt|steht|gibt|findet|enthält|sagen)\b.{0,40}?\b(?:nichts|keine?)\b|
        die auszüge (?:schweigen|sagen nichts|enthalten nichts|geben (?:dazu )?nichts)|kein (?:gefundenes )?thema (?:deckt|behandelt|enthält)|
        (?:der speicher|das archiv) (?:enthält|hat|sagt) (?:dazu )?nichts|das (?:liegt|geht) (?:außerhalb|über))""",
    "fr": r"""(?:en tant qu'assistante?,? )?(?:malheureusement,? )?(?:
        je (?:ne (?:peux|puis|saurais|suis|veux|souhaite|pourrai|vais)\b.{0,20}?\b(?:pas|rien)\b|ne (?:peux|saurais|puis)\b|préfère ne (?:pas|rien)|dois (?:renoncer|décliner|refuser)|refuse|regrette)|
        il m'est impossible|il ne m'est pas possible|(?:la base|le fonds|l'archive|les extraits|les thèmes)\b.{0,10}?\bn(?:e |')\s?.{0,15}?\b(?:rien|pas|aucune?)\b|
        les extraits (?:sont muets|se taisent)|aucun (?:thème|extrait)\b.{0,15}?\bne\b|(?:cette question|cela) (?:dépasse|sort|n'apparaît))""",
    "es": r"""(?:como asistente,? )?(?:lamentablemente,? )?(?:
        (?:lo siento,? )?(?:no (?:puedo|podría|me es posible|voy a|quiero|estoy en condiciones)|prefiero no|preferiría no|debo (?:renunciar|declinar|rechazar)|tengo que (?:renunciar|declinar|rechazar)|me (?:es|resulta) imposible|me niego|me temo que no)\b|
        los extractos no (?:dicen|mencionan|contienen)|ningún tema (?:cubre|trata|menciona)|(?:el almacén|el archivo|la base) no (?:contiene|tiene|dice) nada|esta pregunta (?:queda|está|cae) fuera|no hay (?:suficiente|nada))""",
    "pt": r"""(?:como assistente,? )?(?:infelizmente,? )?(?:
        (?:lamento,? (?:mas )?)?(?:não (?:posso|poderia|me é possível|consigo|vou|quero|estou em condições)|prefiro não|preferia não|tenho de (?:renunciar|recusar|declinar)|devo (?:renunciar|recusar|declinar)|é-me impossível|não me é possível|recuso-me)\b|
        os excertos (?:não (?:dizem|mencionam|contêm)|nada dizem|são omissos)|nenhum tema (?:cobre|trata|menciona)|(?:o arquivo|a base|o armazém) não (?:tem|contém|diz) nada|esta pergunta (?:fica|está|cai) fora|não há (?:contexto|nada|informação))""",
    "ru": r"(?:к сожалению,? |извините,? )?(?:я не (?:могу|буду|в состоянии|стану)|не могу|мне (?:невозможно|не удастся|трудно)|вынужден(?:а)? отказать|в (?:выдержках|архиве|отрывках) (?:ничего|нет)|ни одна тема)",
    "ja": r"(?:申し訳(?:ありません|ございません)[がけ]?.{0,6}|残念ながら)?.{0,40}(?:お答え(?:でき(?:ません|かねます))|回答(?:でき|を控え|はできません)|お手伝いできません|申し上げられません|述べることはできません|わかりかねます|(?:抜粋|資料|保管庫)に(?:は|も).{0,20}(?:ありません|ません))",
    "zh": r"(?:抱歉|对不起|很遗憾)?[，,]?.{0,6}(?:我(?:无法|不能|不便|不会|没法|恐怕)|无法(?:回答|就此|对此)|摘录(?:中|里)?(?:没有|未)|没有(?:任何)?主题)",
}
# A grammar of refusals by language: who speaks, that they cannot or will not, and what (apostrophes straight, small letters).
_EN_ACT = r"(?:answer|reply|respond|discuss|comment|help|assist|say|talk|speak|speculate|guess|share|provide|give|tell|go into|weigh in|disclose|offer|address|advise|do (?:that|this|so)|engage|elaborate|offering|answering|discussing|commenting|helping|sharing|speculating|guessing|providing|giving|going into|touch on)"
GRAMMAR = {
    "en": rf"""(?:as an? [a-z -]{{0,40}}?(?:assistant|model|ai),? )?(?:(?:i|we|this assistant|the assistant)(?:'m| am|'re| are| is|'d| would| do|'ll| will| have| must)? ?
        (?:can't|cannot|can not|could not|couldn't|won't|not going|not able|unable|not allowed|not permitted|not comfortable|not willing|unwilling|not authori[sz]ed|not in a position|not prepared|rather not|prefer not|not|decline|declining|refuse|refusing|refrain|refraining|have to decline|must decline|have to refuse|to decline|obliged to decline)\b
        (?: (?:to|from|in|with|be|able|really|simply|possibly|any))* ?{_EN_ACT}\b|
        (?:that|this|it)(?:'s| is) (?:not |isn't )(?:something|a (?:topic|question|subject|matter|request)|an area|anything)\b.{{0,30}}\b(?:i|we)(?: can|'m| am|'re| are| could)\b|
        (?:that|this|it)(?:'s| is) (?:something|a (?:topic|question|subject|matter|request)|an area)\b.{{0,30}}\b(?:i|we) (?:can't|cannot|won't|am not|are not|must decline)\b|
        (?:my|our|the) (?:guidelines?|polic(?:y|ies)|instructions?|rules?|programming|role|terms)\b.{{0,20}}?\b(?:do not|don't|does not|doesn't|prevents?|prohibits?|forbids?|keeps?|stops?|bars?|won't)\b|
        (?:i|we) have (?:no|nothing) (?:comment|to (?:say|add|share|offer))\b|no comment\b)""",
    "de": r"""(?:(?:das|dies|dazu|darauf|darüber|hierzu|davon|dabei|diese frage|dieser frage|diese anfrage)\b.{0,30}?\b(?:kann|darf|möchte|will|werde|muss) ich\b.{0,50}?\b(?:nicht|nichts|keine?|ablehnen|verzichten)\b|
        (?:meine|unsere|die) (?:richtlinien|vorgaben|regeln|anweisungen|vorschriften)\b.{0,40}?\b(?:nicht|untersagen|verbieten|verhindern)\b|
        ich (?:lehne|verzichte|weigere|enthalte)\b|dabei kann ich\b.{0,20}?\bnicht\b|es ist mir nicht (?:gestattet|erlaubt))""",
    "fr": r"""(?:(?:mes|nos|les) (?:directives|consignes|règles|instructions)\b.{0,40}?\b(?:pas|interdisent|empêchent)\b|ce n'est pas (?:un sujet|une question|quelque chose)\b.{0,30}?\bje\b|
        (?:je |nous )(?:ne (?:répondrai|commenterai|dirai|suis|peux|pouvons|sommes|pourrai)|m'abstiens|décline|refuse|préfère m'abstenir|ne souhaite)\b|je n'ai pas (?:le droit|l'autorisation)|je regrette,? mais)""",
    "es": r"""(?:(?:mis|nuestras|las) (?:directrices|normas|pautas|instrucciones|reglas|políticas)\b.{0,20}?\b(?:no|impiden|prohíben)\b|(?:eso|esto) no es algo\b|no (?:responderé|comentaré|hablaré|diré|contestaré|estoy autorizad|tengo permitido|me corresponde|podemos)|
        (?:me abstengo|me abstendré|rechazo|declino|prefiero (?:no|abstenerme))\b|no se me permite\b)""",
    "pt": r"""(?:(?:as )?(?:minhas|nossas) (?:diretrizes|regras|instruções|normas|políticas)\b.{0,20}?\b(?:não|impedem|proíbem)\b|(?:isso|isto) não é algo\b|não (?:responderei|comentarei|falarei|direi|estou autorizad|me é permitido|podemos|me cabe)|
        (?:abstenho-me|recuso|declino|prefiro (?:não|abster))\b)""",
    "it": r"""(?:(?:mi (?:dispiace|spiace)|purtroppo|spiacente|scusi|scusa)\b[,.]? ?(?:ma )?)?(?:(?:a questo |su questo |di questo )?non (?:posso|possiamo|potrei|sono in grado|sono autorizzat\w|mi è (?:possibile|permesso|consentito)|intendo|voglio|desidero|risponderò|commenterò)\b|
        preferi(?:sco|rei) non\b|(?:devo|sono costrett\w a) (?:rifiutare|declinare|astenermi)|mi (?:rifiuto|astengo|è impossibile)\b|(?:le mie|le nostre) (?:linee guida|regole|istruzioni|direttive)\b.{0,20}?\b(?:non|impediscono|vietano)\b|declino\b)""",
    "nl": r"""(?:(?:het spijt me|sorry|helaas|mijn excuses)\b[,.]? ?(?:maar )?)?(?:(?:ik|wij|we) (?:kan|kunnen|mag|mogen|wil|willen|zal|zullen|ben|zijn|ga)\b.{0,50}?\b(?:niet|niets|geen)\b|(?:daar\w*|hier\w*|dat|deze vraag|dit|helaas)\b.{0,20}?\b(?:kan|mag|wil|ga|zal) ik\b.{0,40}?\b(?:niet|niets|geen)\b|
        (?:kan|mag|wil) ik\b.{0,40}?\b(?:niet|niets|geen)\b|het is (?:mij|me|voor mij) niet (?:mogelijk|toegestaan)|ik (?:weiger|onthoud)\b|(?:mijn|onze) (?:richtlijnen|regels|instructies)\b.{0,30}?\b(?:niet|geen|verbieden)\b)""",
    "ru": r"""(?:(?:я |мы )?(?:не (?:могу|можем|буду|имею права|стану|готов|вправе)|отказываюсь|воздержусь|предпоч(?:ту|итаю) не)\b|мне (?:нельзя|запрещено|не разрешено|не положено)|(?:мои|наши) (?:правила|инструкции|указания)\b.{0,30}?(?:не позволяют|не разрешают|запрещают)|это не то,? о ч[её]м я)""",
    "ar": r"""(?:(?:عذرا|عذراً|آسف|آسفة|أنا آسف|للأسف|أعتذر|معذرة|مع الأسف|يؤسفني)[^.؟!]{0,12}?)?(?:ولكن(?:ني|ي)? ?|لكن(?:ني|ي)? ?)?(?:أنني |أني |إنني |إني )?(?:لا (?:أستطيع|يمكنني|أقدر|يسعني|أريد|أود|يحق لي|يسمح لي|نستطيع|يمكننا|يجوز لي)|لن (?:أجيب|أتمكن|أستطيع|أعلق|أناقش)|لست (?:قادرا|قادراً|مخولا|مخولاً|في وضع|مؤهلا)|ليس (?:بإمكاني|في وسعي|بوسعي|لدي ما|من صلاحياتي)|أفضل (?:عدم|ألا|أن لا)|أرفض|أمتنع|يتعذر علي|(?:إرشاداتي|قواعدي|سياستي|تعليماتي|سياساتنا) (?:لا تسمح|تمنع))""",
    "ko": r"""(?:(?:죄송|유감|아쉽|미안|안타깝)[^.!?]{0,40}?)?[^.!?]{0,50}?(?:(?:답변|대답|도움|도와|말씀|언급|논의|의견|설명|답)[^.!?]{0,12}?(?:드릴|드리기|할|하기|줄|주기|드리지|하지|해드릴) ?(?:수(?:가|는)? ?없|어렵|어려울|곤란|힘들|못하|않겠|않습)|답할 수 없|답변을 (?:거절|거부|삼가)|응답할 수 없|허용되지 않아 답|제 (?:지침|규정)[^.!?]{0,12}허용하지)""",
    "hi": r"""(?:(?:क्षमा करें|क्षमा कीजिए|माफ़ कीजिए|माफ़ करें|माफ करें|खेद है|दुर्भाग्य से|मुझे खेद है)[^।?!]{0,10}?)?(?:लेकिन |कि |पर )?(?:(?:मैं|हम)\b[^।?!]{0,80}?(?:नहीं (?:कर|दे|बता|कह|बोल) ?(?:सकता|सकती|सकते|पाऊँगा|पाऊंगा|पाऊँगी|पाएँगे)|नहीं (?:दूँगा|दूंगा|करूँगा|करूंगा|कहूँगा|बताऊँगा|चाहता|चाहूँगा)|असमर्थ|इनकार|मना कर)|मुझे[^।?!]{0,40}?अनुमति नहीं|मेरे (?:दिशानिर्देश|नियम)[^।?!]{0,40}?(?:नहीं|रोकते))""",
    "th": r"""(?:(?:ขออภัย|ขอโทษ|เสียใจ|น่าเสียดาย)[^.?!]{0,20}?)?(?:แต่)?(?:ผม|ฉัน|ดิฉัน|เรา|ข้าพเจ้า)?[^.?!]{0,16}?(?:ไม่สามารถ|ไม่อาจ|ขอไม่|ไม่ขอ|ปฏิเสธที่จะ|ขอปฏิเสธ|ไม่ได้รับอนุญาตให้|ไม่สะดวกที่จะ|ไม่ประสงค์จะ)[^.?!]{0,16}?(?:ตอบ|ช่วย|ให้|แสดง|พูด|บอก|อธิบาย|กล่าว|คาดเดา)""",
    "el": r"""(?:(?:λυπάμαι|λυπούμαι|δυστυχώς|συγγνώμη|με συγχωρείτε)\b[,.]? ?(?:αλλά )?)?(?:(?:εγώ )?δεν (?:μπορώ|μπορούμε|δύναμαι|είμαι σε θέση|μου επιτρέπεται|επιτρέπεται να|θα (?:απαντήσω|σχολιάσω|μπορέσω)|θέλω να|επιθυμώ)|αδυνατώ|αρνούμαι|προτιμώ να μην|οφείλω να αρνηθώ|(?:οι )?(?:οδηγίες|κανόνες|κατευθύνσεις) μου\b.{0,20}?\b(?:δεν|απαγορεύουν))""",
    "ja": r"""(?:.{0,40}?(?:答える|回答する|お話しする|コメントする|お手伝いする|説明する|議論する)(?:こと|の)(?:は|が|も)(?:でき(?:ません|ない|かね)|難し|控え)|.{0,30}?(?:回答|コメント|お答え|言及)(?:は|を)?(?:差し控え|控えさせ|いたしかね|できかね|お断り)|.{0,20}?(?:ガイドライン|規則|方針).{0,30}?(?:許可|認め|許さ|禁じ).{0,12}?(?:ません|ない|ています))""",
    "zh": r"""(?:(?:抱歉|对不起|很遗憾|不好意思|很抱歉)[，,。]?)?(?:但|不过)?(?:关于|对于)?[^。！？]{0,14}?(?:我|我们)?(?:无法|不能|不便|不会|没办法|没法|拒绝|不愿|不打算|难以|恕难|恕不|无权|不被允许)(?:就|对|为|向|再|直接|给)?[^。！？]{0,12}?(?:回答|答复|讨论|评论|提供|帮|协助|透露|说明|告诉|置评|猜测|作答)|(?:我的|我们的)(?:准则|规定|指引|政策|原则)[^。！？]{0,10}?(?:不允许|禁止|不准)|这不是我(?:能|可以|应该)""",
}
#: After an inability that is no refusal ("I cannot say more than the claims do, but ...").
NOT_REFUSALS = r"(?:cannot|can't|could not|couldn't) (?:say|add|tell you) (?:any ?)?(?:more|further)\b.{0,40}\b(?:but|yet|than)|nicht mehr sagen als|ne peux (?:pas )?(?:en )?dire (?:plus|davantage) que|no puedo decir más (?:que|de lo)|não posso dizer mais do que|cannot (?:stress|overstate|emphasi[sz]e)|не могу сказать больше"
# Frequent function words of languages written in Latin letters.
WORDS = {
    "en": "the a an and of to is are was were in on for with that this it as at by from they we our not no which because whenever while after before has have had been be do does did than or one two three about so there its their who why what how many when such without once even every",
    "de": "der die das den dem des ein eine einen einem einer und oder ist sind war nicht kein keine für mit auf von zu zum zur im in am an bei nach aus seit über wir sie er es ich dass daß wie was warum wer immer noch beim darin unser unsere ihre jeden schon lieber dazu haben hat wird werden ab auch viele bitte",
    "fr": "le la les l un une des du de d et ou est sont ne n pas plus ce cette ces que qu qui dans sur pour par avec au aux il elle on nous vous je notre nos leur se s à en y même trop souvent encore depuis deux trois rien aucun aucune chaque sait dit pourquoi combien surtout",
    "es": "el la los las un una unos unas de del y o es son no que en con por para al a se su sus nuestro nuestra nuestros lo le les más muy ya sin cada qué cuál cuántos quién como esta este esto sobre ha han dos tres dice ningún nada porque me puedo",
    "pt": "o a os as um uma uns umas de do da dos das e ou é são não que em no na nos nas com por para ao aos à às se seu sua nosso nossa nossos pelo pela mais muito já sem cada qual quem quantos como esta este isto sobre há duas dois três nada nenhum porque todas todos continua me posso",
    "it": "il lo la gli le un uno una di del della dei degli e o è sono non che in con per al alla nel nella su si suo sua nostro più molto già senza ogni cosa chi come questo questa due tre nulla nessun perché",
    "nl": "de het een en of is zijn was niet geen voor met op van te in aan bij naar uit sinds over wij ze hij ik dat wie wat waarom altijd nog onze elke al veel ook hebben heeft wordt",
}
_SCRIPTS = (("ru", r"\p{Cyrillic}"), ("el", r"\p{Greek}"), ("ar", r"\p{Arabic}"), ("hi", r"\p{Devanagari}"), ("th", r"\p{Thai}"), ("ko", r"\p{Hangul}"), ("ja", r"[\p{Hiragana}\p{Katakana}]"), ("zh", r"\p{Han}"), ("he", r"\p{Hebrew}"), ("latin", r"\p{Latin}"))
_CITATION = r"(?:\((?:THEME-\d+(?:, claim [0-9a-f]{12})?|claim [0-9a-f]{12})\)|\[(?:THEME-\d+|[0-9a-f]{12})(?:, ?(?:THEME-\d+|[0-9a-f]{12}))*\])"


class Judge:
    """The rules for one pair; made in the worker."""

    def __init__(self) -> None:
        import regex

        self.hidden = regex.compile(r"[\p{Cf}\p{Cc}\p{Z}\s]+")
        self.word = regex.compile(r"[\p{L}\p{M}\p{N}]+")
        self.scripts = [(k, regex.compile(p)) for k, p in _SCRIPTS]
        self.not_latin = regex.compile(r"[\p{Latin}\P{L}]+")
        self.owner: dict[str, list[str]] = {}
        for lang, words in WORDS.items():
            for w in words.split():
                self.owner.setdefault(w, []).append(lang)
        flat = lambda p: re.sub(r"\n\s*", "", p)
        self.opening = regex.compile(flat(OPENINGS))
        self.refusal = regex.compile("(?:" + "|".join(f"(?:{flat(p)})" for p in [*REFUSALS.values(), *GRAMMAR.values()]) + ")", regex.S)
        self.sentence = regex.compile(r"[^.!?。！？।؟]*")
        self.not_refusal = regex.compile(NOT_REFUSALS)
        self.nothing = {w for w in flat(NOTHING).split("|")}
        self.longest = max(map(len, self.nothing))
        self.citation = re.compile(_CITATION)
        self.quoted = re.compile(r"“[^”]*”|„[^“”]*[“”]|«[^»]*»|\"[^\"]*\"|「[^」]*」|『[^』]*』")
        self.label = regex.compile(r"^[\s\W]*(?:(?:the |my |your )?(?:q|a|question|answer|prompt|response|reply|frage|antwort|réponse|pregunta|respuesta|pergunta|resposta|вопрос|ответ|質問|回答|问题|答案|問題)\s*\d*\s*[:：.)–—-]\s*)+", regex.I)

    def given(self, text: str | None) -> str:
        """The text without outer blanks and hidden characters; '' where nothing is said."""
        if not text:
            return ""
        s = self.hidden.sub(" ", text).strip()
        n = 0
        for c in s:  # more letters than any stand-in has: something is said
            n += c.isalnum()
            if n > self.longest:
                return s
        core = "".join(c if c.isalnum() or c in "/." else " " for c in s.casefold()).strip(" ./")
        core = " ".join(core.split())
        return "" if not core or core in self.nothing else s

    def tokens(self, text: str) -> list[str]:
        return self.word.findall(text.casefold())

    def copied(self, question: str, answer: str) -> bool:
        q, a = self.tokens(question), self.tokens(self.label.sub("", answer))
        if not q or not a:
            return False
        if not any(ord(c) < 0x2E80 for w in q for c in w):
            q, a = list("".join(q)), list("".join(a))
        slack = max(1, len(q) // 12)
        for times in (1, 2, 3):
            off = slack * times
            if abs(len(a) - times * len(q)) > off:
                continue
            want = q * times
            if sum(((Counter(a) - Counter(want)) + (Counter(want) - Counter(a))).values()) > 2 * off:
                continue
            # Edit distance within a band, so that order counts and long texts stay cheap.
            row = {j: j for j in range(off + 1)}
            for i, x in enumerate(a, 1):
                new = {}
                for j in range(max(0, i - off), min(len(want), i + off) + 1):
                    best = row.get(j, 1 << 30) + 1
                    if j:
                        best = min(best, new.get(j - 1, 1 << 30) + 1, row.get(j - 1, 1 << 30) + (x != want[j - 1]))
                    new[j] = best
                row = new
            if row.get(len(want), 1 << 30) <= off:
                return True
        return False

    def refused(self, text: str) -> bool:
        s = self.quoted.sub(" ", text).replace("’", "'").casefold().strip(" \t\r\n-–—*•")
        while s:
            if self.not_refusal.search(self.sentence.match(s)[0]):
                return False
            if self.refusal.match(s):
                return True
            m = self.opening.match(s)
            if not m or not m.end():
                return False
            s = s[m.end() :]  # openings are taken off one by one, however many
        return False

    def cut(self, text: str) -> bool:
        s = text.rstrip()
        if re.search(r"(?:^|\s)(?:[-–—•*+]|\(?\d{1,3}[.)]|\(?[a-z][.)])$", s):
            return True
        if re.search(r"(?:…|\.\.\.?|[,;:、，；：])[\"'”’»)\]]*$", s):
            return True
        core = self.citation.sub(" ", s)
        for o, c in ("()", "[]", "{}", "“”", "«»", "「」", "『』", "（）"):
            if core.count(o) > core.count(c):
                # A list mark "1)" closes what nothing opened, so only a missing end counts.
                return True
        if core.count('"') % 2 or core.count("```") % 2:
            return True
        if core.count("„") > sum(core.count(c) for c in "“”"):
            return True
        if re.search(_CITATION + r"[\"'”’»]*$", s):
            return False
        return not re.search(r"[.!?。！？।؟｡⁈⁉‼][\"'”’»」』)\]）*_`]*$", s) and not s.endswith("```")

    def language(self, text: str) -> str | None:
        """Script of most letters; within Latin, the language of most function words. None if it can't be told."""
        core = self.citation.sub(" ", self.quoted.sub(" ", text))
        if len(self.tokens(core)) < 3:
            core = self.citation.sub(" ", text)
        other = "" if core.isascii() else self.not_latin.sub("", core)
        if other:
            n = {k: len(p.findall(core)) for k, p in self.scripts}
        else:  # nothing but Latin letters
            n = {k: 0 for k, _ in self.scripts} | {"latin": int(any(map(str.isalpha, core)))}
        if n["ja"]:
            n["ja"] += n["zh"]
            n["zh"] = 0
        script = max(n, key=n.get)
        if not n[script]:
            return None
        if script != "latin":
            return script if n[script] >= 4 else None
        score: Counter = Counter()
        for w in self.tokens(core.replace("’", " ").replace("'", " ")):
            for lang in self.owner.get(w, ()):
                score[lang] += 1 / len(self.owner[w])
        top = score.most_common(2)
        if not top or len(top) > 1 and top[0][1] < top[1][1] * 1.3 + 0.4:
            return None
        return top[0][0]

    def defects(self, question: str | None, answer: str | None, reason: str | None) -> list[str]:
        q, a, r = (self.given(x) for x in (question, answer, reason))
        if not a and not r:
            return ["empty"]
        out = []
        copy = bool(a and q) and self.copied(q, a)
        if copy:
            out.append("copy")
        if r or a and self.refused(answer or ""):
            out.append("refusal")
        if a and not copy and self.cut(answer or ""):
            out.append("truncated")
        if a and q and not copy:
            x, y = self.language(q), self.language(a)
            if x and y and x != y:
                out.append("language")
        return out


def defects(df: DataFrame, key: str, question: str, answer: str, reason: str) -> DataFrame:
    """(key, defect) for every defect of every pair."""
    src = df.select(F.col(key).alias("k"), F.col(question).alias("q"), F.col(answer).alias("a"), F.col(reason).alias("r"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        judge = Judge()
        text = lambda x: x if isinstance(x, str) else None
        for b in batches:
            rows = [(k, d) for k, q, a, r in zip(b["k"], b["q"], b["a"], b["r"]) for d in judge.defects(text(q), text(a), text(r))]
            yield pd.DataFrame(rows, columns=["k", "defect"])

    return src.mapInPandas(run, f"k {dict(src.dtypes)['k']}, defect string").withColumnRenamed("k", key)
