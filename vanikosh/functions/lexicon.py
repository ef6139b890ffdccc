"""Word lists and character classes that results must agree with."""

# --- numbers ---------------------------------------------------------------------

#: Number words for 0 to 99 in order; variants of one number stand together.
UNIT_WORDS = (
    "शून्य", "एक", "दो", "तीन", "चार", "पाँच पांच", "छह छः", "सात", "आठ", "नौ",
    "दस", "ग्यारह", "बारह", "तेरह", "चौदह", "पंद्रह", "सोलह", "सत्रह", "अठारह", "उन्नीस",
    "बीस", "इक्कीस", "बाईस", "तेईस", "चौबीस", "पच्चीस", "छब्बीस", "सत्ताईस", "अट्ठाईस", "उनतीस",
    "तीस", "इकतीस", "बत्तीस", "तैंतीस", "चौंतीस", "पैंतीस", "छत्तीस", "सैंतीस", "अड़तीस", "उनतालीस",
    "चालीस", "इकतालीस", "बयालीस", "तैंतालीस", "चवालीस", "पैंतालीस", "छियालीस", "सैंतालीस", "अड़तालीस", "उनचास",
    "पचास", "इक्यावन", "बावन", "तिरपन", "चौवन", "पचपन", "छप्पन", "सत्तावन", "अट्ठावन", "उनसठ",
    "साठ", "इकसठ", "बासठ", "तिरसठ", "चौंसठ", "पैंसठ", "छियासठ", "सरसठ", "अड़सठ", "उनहत्तर",
    "सत्तर", "इकहत्तर", "बहत्तर", "तिहत्तर", "चौहत्तर", "पचहत्तर", "छिहत्तर", "सतहत्तर", "अठहत्तर", "उनासी",
    "अस्सी", "इक्यासी", "बयासी", "तिरासी", "चौरासी", "पचासी", "छियासी", "सतासी", "अठासी", "नवासी",
    "नब्बे", "इक्यानवे", "बानवे", "तिरानवे", "चौरानवे", "पचानवे", "छियानवे", "सत्तानवे", "अट्ठानवे", "निन्यानवे",
)
MULTIPLIERS = {"सौ": 100, "हज़ार": 1_000, "हजार": 1_000, "लाख": 100_000, "करोड़": 10_000_000, "करोड": 10_000_000}
#: Numbers that digits and words may stand for in each other's place.
DIGIT_NUMBERS = (*range(16), 20, 25, 30, 40, 50, 60, 70, 80, 90)
DIGIT_MULTIPLIERS = {"100": ("सौ",), "1000": ("हज़ार", "हजार"), "100000": ("लाख",)}
#: Phrases that keep their number words: alternatives of a word, blanks, and what follows.
IDIOM_HYPHEN = (("एक", "दो", "तीन", "चार", "पाँच", "पांच"), ("एक", "दो", "तीन", "चार", "पाँच", "पांच", "छह", "सात", "आठ", "नौ", "दस"))
IDIOM_PAIRS = (
    (("एक", "दो"), ("तरफ", "ओर", "दिशा", "जगह", "बार में")),
    (("दो", "तीन"), ("नम्बर", "नंबर")),
    (("एक",), ("बात", "सवाल", "पल", "नज़र", "दिन")),
)

# --- English and loan words --------------------------------------------------------

LOANWORDS = (
    "प्रोजेक्ट इंटरव्यू इन्टरव्यू जॉब ऑफिस कंप्यूटर कम्प्यूटर इंटरनेट मोबाइल फोन लैपटॉप ईमेल फाइल फॉर्म रिपोर्ट प्रेजेंटेशन मीटिंग सर्टिफिकेट डिग्री कोर्स क्लास "
    "सेमेस्टर कॉलेज यूनिवर्सिटी स्कूल फीस रिजल्ट मार्क्स परसेंट रैंक एरिया रोड हाईवे फ्लाईओवर स्टेशन एयरपोर्ट होटल रूम फ्लोर लिफ्ट पार्किंग मॉल बस ट्रेन टैक्सी "
    "बाइक कार ट्रक वैन टेंट कैम्प कैम्पिंग टॉर्च लाइट बैटरी मिस्टेक प्रॉब्लम सॉल्यूशन चेक प्लान टाइम नम्बर नंबर सीट टिकट बुकिंग गार्ड डॉक्टर नर्स इंजीनियर मैनेजर "
    "बॉस टीम पार्टनर फ्रेंड फ्रेंड्स वीडियो फोटो सेल्फी चैनल सीरीज शो मूवी सॉन्ग म्यूजिक डांस किलोमीटर मीटर लीटर किलो टन परसेंटेज सेकंड मिनट ऑवर"
).split()
NATIVISED = "स्कूल बस ट्रेन कार टेबल चेयर डॉक्टर किलोमीटर मीटर लीटर किलो मिनट सेकंड".split()
#: Beginnings of words, and letters anywhere, that speak for an English origin.
ENGLISH_BEGINNINGS = "प्र स्ट स्प फ्र ट्र ड्र".split()
ENGLISH_LETTERS = "ॉऑ"
#: Punctuation that a tag leaves outside.
TAG_PUNCTUATION = "।,.!?;:-\"'()"

# --- spelling ------------------------------------------------------------------------

SPELLING_LOANWORDS = (
    "ऑफिस ऑनलाइन ऑफलाइन ऑडियो ऑर्डर ऑप्शन ऑटो प्रोजेक्ट प्रॉब्लम प्रेशर प्रेजेंटेशन प्रोसेस प्रोग्राम इंटरव्यू इंटरनेट इंजीनियर इंस्टाग्राम इंस्टॉल स्कूल स्टेशन "
    "स्टूडेंट स्टाफ स्ट्रेस स्पीड स्मार्ट ट्रेन ट्रक ट्रेनिंग ट्रांसफर ट्रिप कंप्यूटर कंट्रोल कंटेंट कंपनी कंफर्म फोन फेसबुक फाइल फॉर्म फ्री फ्रेंड फ्यूचर मोबाइल "
    "मीटिंग मैनेजर मार्केट मेसेज वीडियो वेबसाइट वर्कशॉप वॉट्सएप एरिया एग्जाम एडमिशन एप एप्लीकेशन टेंट टेस्ट टाइम टॉपिक टीम टिकट सिस्टम सीरियस सर्विस सेशन सोशल "
    "डेटा डिजिटल डिस्काउंट डिग्री डायरेक्ट बैंक बजट बेनिफिट बोनस बैकग्राउंड पासवर्ड पेमेंट पैकेज पोस्ट प्लान पॉजिटिव नोटिस नेटवर्क नॉर्मल लैपटॉप लिंक लेवल लोकेशन "
    "रिपोर्ट रिजल्ट रजिस्टर रिक्वेस्ट हेल्थ होटल हाईवे जॉब जेनरल ज़ूम गूगल गार्ड ग्रुप गाइड क्लास क्लियर क्रेडिट क्वेश्चन चार्ज चेक चैनल चैट ब्लॉक ब्रांड ब्रेक "
    "मिस्टेक मिनट मीडिया मोड सबमिट सपोर्ट स्टॉप लाइट लॉगिन लिस्ट रेट रोड रूल कैम्प कैम्पिंग कैलकुलेटर कोड कोर्स कॉलेज पार्टी पार्किंग पॉलिसी परसेंट प्रिंट डॉक्टर "
    "डाउनलोड डील नंबर नम्बर किलोमीटर किलो सेकंड सेंटर साइट मार्क्स मैच मीटर ओके हाय बाय थैंक्यू"
).split()
#: Consonants by code point; the nukta counts as one.
CONSONANTS = "कखगघङचछजझञटठडढणतथदधनपफबभमयरलवशषसहळऴ़"
VOWEL_LETTERS = "अआइईउऊऋऌएऐओऔऄऍऎऑऒ"
VOWEL_SIGNS = "ािीुूृॄेैोौ"
HALANT, ANUSVARA, CHANDRABINDU, VISARGA, NUKTA, AVAGRAHA = "्", "ं", "ँ", "ः", "़", "ऽ"
LONE_VOWEL = "ऑ"
VALID_SINGLES = "अआइईउऊएऐओऔनव।हयतकस"
COMMON_SHORT = "का की के को से ने ही तो भी या और हो है था थी थे जो वो इस उस कि अब जी नो वे आप ओह हा ना रे".split()
CLUSTERS = "प्र स्ट ट्र ड्र फ्र ग्र क्र".split()
LONGEST, LONG = 35, 18

# --- errors and their repair -----------------------------------------------------------

POSTPOSITIONS = "में से को के का की ने पर तक लिए साथ बाद पहले".split()
COUNT_WORDS = "एक दो तीन चार पाँच पांच छह सात आठ नौ दस सौ हज़ार हजार लाख".split()
REPAIRED_POSTPOSITIONS = "को से में के का की ने पर तक".split()
#: The first is written with a letter that composed text has in two parts, so it never occurs there.
FEMININE_PLURAL = ("ल\u095cकियाँ", "औरतें", "महिलाएं")
SUFFIXES = "ता ती ते ना नी ने कर या यी ये".split()
#: Stems of the next word, the postpositions they don't go with, and the one they take.
GOVERNMENT = (
    ("दे दिया दी दो बता मिल बोल कह".split(), "में से पर".split(), "को"),
    ("आ आया आई आए जा गया गई गए निकल भाग ले".split(), "में को पर".split(), "से"),
    ("रह रहा रही रहे हो था थी थे बैठ".split(), "से को पर".split(), "में"),
)
CATEGORIES = {
    "NUMERIC_MISMATCH": "the same number, once in words and once in digits",
    "INSERTION": "a word that the reference does not have",
    "DELETION_FUNC": "a missing short function word",
    "DELETION_CONTENT": "a missing content word",
    "POSTPOSITION_ERROR": "a wrong postposition",
    "GRAM_INFLECTION": "the same stem with another ending",
    "PHONETIC_CONF": "words that sound alike",
    "COMPOUND_SPLIT": "one word written inside another",
    "OTHER_SUBST": "any other replaced word",
}
