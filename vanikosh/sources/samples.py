"""Small texts in code, and tables generated from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vanikosh.functions.text import normalized

# --- fixed values: pairs of what was said and what was recognised ------------------------

ERROR_PAIRS = (
    ("अब काफी अच्छा होता है क्योंकि उनकी जनसंख्या बहुत कम है", "अब काफी अच्छा होता है क्योंकि उनकी जनसंख्या बहुत कम है"),
    ("जंगल का सफर होता है जब हम रहने के लिए गए थे", "जंगल का सफर होता है जब हम रहने के लिये गए थे"),
    ("पहली बारी था क्योंकि चलना नहीं आता न", "पहली बार था क्योंकि चलना नहीं आता न"),
    ("बहुत अजीब सा डर तो इतना लगा था", "बहुत अजीब सा डर तो इतना लगा"),
    ("हम ने मिस्टेक किए कि हम लाइट नहीं ले गए थे", "हमने मिस्टेक किया कि हम लाइट नहीं ले गए"),
    ("आराम से सो रहे थे हम और पता है", "आराम से सो रहे थे हम"),
    ("रोड का जो एरिया वो रोड पे हम लोग को छोड़ने आए", "रोड का जो एरिया वो रोड पर हम लोगों को छोड़ने आए"),
    ("हम लोग टेंट वगेरा अगर कहीं भी कैम्पिंग करने जाते हैं", "हम लोग टेंट वगैरा अगर कहीं भी कैंपिंग करने जाते हैं"),
    ("डर लगता है लेकिन बहुत सारे थे तो सब अपना कैम्प डाल के रह रहा था", "डर लगता है लेकिन बहुत सारे थे सब अपना कैम्प डालके रह रहे थे"),
    ("उन्होंने बताया कि यहाँ का मौसम बहुत अच्छा रहता है", "उन्होंने बताया की यहाँ का मौसम बहुत अच्छा रहता है"),
    ("यह काम बहुत मुश्किल था लेकिन हमने इसे पूरा किया", "यह काम बहुत मुश्किल था लेकिन हमने इसे पूरा किए"),
    ("शहर में रहने के लिए बहुत खर्च होता है", "शहर में रहने के लिए बहुत खर्चा होता है"),
    ("वो लोग बहुत मेहनती हैं और हमेशा समय पर काम करते हैं", "वो लोग बहुत मेहनती है और हमेशा समय पर काम करते है"),
    ("इस साल बारिश कम हुई है इसलिए फसल भी कम होगी", "इस साल बारिश कम हुई है इसलिए फसल भी कम होगा"),
    ("हमने मिलकर यह फैसला किया कि अब आगे बढ़ना है", "हमने मिलकर यह फैसला किया कि आगे बढ़ना है"),
    ("बच्चे स्कूल से लौट आए और खाना खाने लगे", "बच्चे स्कूल से लौट आए और खाना खाने लगे"),
    ("उसने कॉलेज में प्रेजेंटेशन दिया और रिजल्ट अच्छा आया", "उसने कॉलेज में प्रेजेंटेशन दी और रिजल्ट अच्छा आया"),
    ("हमारा प्रोजेक्ट भी था कि जो जनजाति पाई जाती है उधर की एरिया में", "हमारा प्रोजेक्ट था कि जो जनजाति पाई जाती है उधर की एरिया में"),
    ("वह हर दिन सुबह जल्दी उठता है और व्यायाम करता है", "वो हर दिन सुबह जल्दी उठता है और व्यायाम करता है"),
    ("मुझे नहीं पता था कि यह इतना आसान होगा", "मुझे नहीं पता था यह इतना आसान होगा"),
)

#: An utterance each, and what five models (A to E) made of it.
LATTICE_SAMPLES = (
    ("उसने चौदह किताबें खरीदीं", ("उसने 14 किताबें खरीदीं", "उसने चौदह किताबे खरीदी", "उसने पंद्रह किताबें खरीदीं", "उसने चौदह पुस्तकें खरीदीं", "उसने चौदह किताबें खरीदीं")),
    ("वह कल स्कूल गया था", ("वह कल स्कूल आया था", "वह कल स्कूल आया था", "वह कल स्कूल आया था", "वह कल स्कूल आया था", "वह कल स्कूल गया था")),
    ("यहाँ बहुत ठंड है", ("यहाँ बहुत ठंड है", "यहां बहुत ठंड है", "यहाँ बहुत ठण्ड है", "यहाँ बहुत ठड है", "यहाँ बहुत सर्दी है")),
    ("मैं तो घर जा रहा हूँ", ("मैं घर जा रहा हूँ", "मैं तो घर जा रहा हूँ", "मैं घर जा रहा हूँ", "मैं तो घर जा रहा था", "मैं घर जा रहा हूँ")),
)


#: Sentences of one recording.
TRANSCRIPTS = (
    "अब काफी अच्छा होता है क्योंकि उनकी जनसंख्या बहुत कम है",
    "अनुभव करके कुछ लिखना था तो वह तो बिना देखे नहीं हो सकती थी",
    "जंगल का सफर होता है जब हम रहने के लिए गए थे",
    "पहली बारी था क्योंकि चलना नहीं आता न वहाँ का जो लैंड एरिया होता है",
    "हां तो फिर वहां जो दिन भर खोजने में वक्त बीत गया",
    "बहुत अजीब सा आवाज आने लगा बहुत अजीब सा डर तो इतना लगा था",
    "डर लगता है लेकिन बहुत सारे थे तो सब अपना अपना कैम्प डाल के रह रहा था",
    "रात को मतलब जैसे छः सात आठ किलोमीटर में नौ बजे है",
    "लगता है कि सर सुबह हो गया लेकिन कोई उठाने वाला नहीं था",
    "हम लोग की तो सुबह होती है की मम्मी उठाने आती है",
    "आराम से सो रहे थे हम और पता है जब उठे ना तो वो लोग चिला रहे थे",
    "बहुत अजीब सा अनुभव था क्योंकि वो उठा उठा के उनको पटक रहे थे",
    "उनको लगा कि शायद उनको खतरा महसूस हो रहा था हम लोग से",
    "हां बाहरी आ गया तो वो अपने भाषा में कुछ बात किए",
    "रोड का जो एरिया वो रोड पे हम लोग को छोड़ने आए",
    "पता है लेकिन जब लोग घूमने जाते हैं तो लाइट वगैरा लेकर जाने चाहिए",
    "हम ने मिस्टेक किए कि हम लाइट नहीं ले गए थे",
    "तो जहां डर रहेगा वहा थोड़ा सा मजा आएगा",
    "आपको एक बात पता जब तंबू गाड़ के रहते हैं तो आसपास आग लहरा देना चाहिए",
    "उसने कॉलेज में प्रेजेंटेशन दिया और रिजल्ट अच्छा आया",
    "हमारा प्रोजेक्ट भी था कि जो जनजाति पाई जाती है उधर की एरिया में",
    "यह काम बहुत मुश्किल था लेकिन हमने इसे पूरा किया",
    "वह हर दिन सुबह जल्दी उठता है और व्यायाम करता है",
    "मुझे नहीं पता था कि यह इतना आसान होगा",
    "उन्होंने बताया कि यहाँ का मौसम बहुत अच्छा रहता है",
    "शहर में रहने के लिए बहुत खर्च होता है",
    "वो लोग बहुत मेहनती हैं और हमेशा समय पर काम करते हैं",
    "इस साल बारिश कम हुई है इसलिए फसल भी कम होगी",
    "हमने मिलकर यह फैसला किया कि अब आगे बढ़ना है",
    "बच्चे स्कूल से लौट आए और खाना खाने लगे",
)

# --- texts of our own -------------------------------------------------------------------

#: Number words inside and outside of phrases that keep them.
NUMBER_TEXTS = (
    "दो-चार बातें करनी हैं", "उसने तीन सौ चौवन रुपये दिए", "एक बात बताओ", "दो - तीन दिन रुको", "वह एक ओर खड़ा था", "घर में पच्चीस लोग हैं",
    "दो नंबर का काम", "एक हज़ार दो सौ पेड़", "पाँच–छह किताबें लाओ", "एक बार में सात गए", "तीन", "", "यहाँ कोई संख्या नहीं",
)


def _share(key: str) -> Column:
    """A pseudorandom number from 0 to below 1 that any SQL can work out: eight hexadecimal digits of the MD5 of the key."""
    return F.conv(F.substring(F.md5(F.col(key).cast("string").cast("binary")), 1, 8), 16, 10).cast("bigint") / 4294967296


def cycled(spark: SparkSession, texts, rows: int) -> DataFrame:
    """``id, text, duration`` of ``rows`` rows that go round the texts; those empty after normalisation are left out.

    The durations, 4 to 18 seconds, are pseudorandom and the same in every run.
    """
    table = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    rounds = spark.range(rows).withColumn("k", F.pmod("id", F.lit(max(1, len(texts)))).cast("int"))
    return rounds.join(F.broadcast(table), "k").select("id", normalized(F.col("text")).alias("text"), (F.floor(4000 + 14_000 * _share("id")) / 1000).alias("duration")).where("text <> ''")


def replicated_pairs(spark: SparkSession, rows: int = 350, pairs=ERROR_PAIRS, blank_share: float = 0.3) -> DataFrame:
    """``id, reference, baseline_pred, ft_pred``: the pairs in turn; a pseudorandom share of the baseline is blank."""
    table = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "k int, reference string, hypothesis string")
    blank = _share("id") < blank_share
    hyp = normalized(F.col("hypothesis"))
    rounds = spark.range(rows).withColumn("k", F.pmod("id", F.lit(len(pairs))).cast("int")).join(F.broadcast(table), "k")
    return rounds.select("id", normalized(F.col("reference")).alias("reference"), F.when(blank, "").otherwise(hyp).alias("baseline_pred"), hyp.alias("ft_pred"))


def lattice_samples(spark: SparkSession) -> DataFrame:
    """``utt, ref, model, hyp`` of the small lattice examples."""
    rows = [(f"Ex{i}", ref, model, hyp) for i, (ref, hyps) in enumerate(LATTICE_SAMPLES, 1) for model, hyp in zip("ABCDE", hyps)]
    return spark.createDataFrame(rows, "utt string, ref string, model string, hyp string")
