"""Fixed tables: values that must be as they are for equal results, one entry a line, in their natural order."""

from __future__ import annotations

# Categories in table order, each with its rank of priority.
PRIORITY = {
    "trafik_kazasi": 2,
    "yangin": 1,
    "elektrik_kesintisi": 4,
    "hirsizlik": 3,
    "kultur_etkinligi": 5,
}

# Fixed values: (category, keyword, weight). A keyword matches at the beginning of a word; "$": only where it also ends there.
KEYWORDS = [
    ("trafik_kazasi", "trafik kaza", 5),
    ("trafik_kazasi", "zincirleme kaza", 5),
    ("trafik_kazasi", "zincirleme", 2),
    ("trafik_kazasi", "kafa kafaya", 3),
    ("trafik_kazasi", "yayaya çarp", 4),
    ("trafik_kazasi", "takla at", 3),
    ("trafik_kazasi", "şarampol", 3),
    ("trafik_kazasi", "kontrolden çık", 3),
    ("trafik_kazasi", "direksiyon hakimiyet", 3),
    ("trafik_kazasi", "çarpıştı", 3),
    ("trafik_kazasi", "çarpışma", 3),
    ("trafik_kazasi", "çarpışan", 3),
    ("trafik_kazasi", "arkadan çarp", 3),
    ("trafik_kazasi", "bariyer", 2),
    ("trafik_kazasi", "refüj", 2),
    ("trafik_kazasi", "devrildi", 3),
    ("trafik_kazasi", "devrilen", 3),
    ("trafik_kazasi", "sürücüsü yaralandı", 3),
    ("trafik_kazasi", "maddi hasar", 3),
    ("trafik_kazasi", "kaza$", 3),
    ("trafik_kazasi", "kazada$", 3),
    ("trafik_kazasi", "kazaya$", 3),
    ("trafik_kazasi", "kazayı$", 3),
    ("trafik_kazasi", "kazayla$", 3),
    ("trafik_kazasi", "kazası$", 2),
    ("trafik_kazasi", "kazalar", 2),
    ("trafik_kazasi", "kazazede", 3),
    ("trafik_kazasi", "otomobil", 1),
    ("trafik_kazasi", "motosiklet", 1),
    ("trafik_kazasi", "kamyon", 1),
    ("trafik_kazasi", "tır$", 1),
    ("trafik_kazasi", "tırın$", 1),
    ("trafik_kazasi", "minibüs", 1),
    ("trafik_kazasi", "sürücü", 1),
    ("trafik_kazasi", "yaralandı", 1),
    ("trafik_kazasi", "ambulans", 1),
    ("trafik_kazasi", "trafik ekip", 1),
    ("trafik_kazasi", "plakalı", 1),
    ("trafik_kazasi", "iş kaza", -6),
    ("trafik_kazasi", "ağaç devril", -6),
    ("trafik_kazasi", "direk devril", -6),
    ("trafik_kazasi", "yeni kavşak", -5),
    ("trafik_kazasi", "kavşak düzenleme", -5),
    ("trafik_kazasi", "kavşak çalışma", -5),
    ("trafik_kazasi", "yol çalışma", -4),
    ("trafik_kazasi", "asfalt", -3),
    ("trafik_kazasi", "ihale", -3),
    ("yangin", "yangın", 4),
    ("yangin", "alevlere teslim", 3),
    ("yangin", "alev aldı", 3),
    ("yangin", "alev alev", 3),
    ("yangin", "alev", 1),
    ("yangin", "küle dön", 4),
    ("yangin", "kül oldu", 4),
    ("yangin", "kundak", 4),
    ("yangin", "tutuştu", 3),
    ("yangin", "tutuşma", 2),
    ("yangin", "söndürül", 3),
    ("yangin", "söndürme", 2),
    ("yangin", "itfaiye", 1),
    ("yangin", "dumandan etkilen", 3),
    ("yangin", "yanarak", 2),
    ("yangin", "yandı$", 3),
    ("yangin", "patlama", 1),
    ("yangin", "tatbikat", -5),
    ("yangin", "yangın söndürme tüpü", -2),
    ("elektrik_kesintisi", "elektrik kesinti", 5),
    ("elektrik_kesintisi", "elektrikler kesil", 5),
    ("elektrik_kesintisi", "elektrikler gitti", 4),
    ("elektrik_kesintisi", "elektriksiz", 4),
    ("elektrik_kesintisi", "enerji kesinti", 5),
    ("elektrik_kesintisi", "planlı kesinti", 4),
    ("elektrik_kesintisi", "plansız kesinti", 4),
    ("elektrik_kesintisi", "kesinti yapılacak", 3),
    ("elektrik_kesintisi", "kesinti uygulanacak", 3),
    ("elektrik_kesintisi", "elektrik verilemeye", 5),
    ("elektrik_kesintisi", "elektrik verilmeye", 5),
    ("elektrik_kesintisi", "sedaş", 2),
    ("elektrik_kesintisi", "elektrik arıza", 4),
    ("elektrik_kesintisi", "karanlıkta kal", 2),
    ("elektrik_kesintisi", "trafo", 1),
    ("elektrik_kesintisi", "elektrik", 1),
    ("elektrik_kesintisi", "kesinti", 1),
    ("elektrik_kesintisi", "su kesinti", -5),
    ("elektrik_kesintisi", "doğalgaz kesinti", -5),
    ("elektrik_kesintisi", "doğal gaz kesinti", -5),
    ("elektrik_kesintisi", "sanayi odası", -5),
    ("elektrik_kesintisi", "seçim", -3),
    ("elektrik_kesintisi", "meclis üye", -3),
    ("hirsizlik", "hırsız", 5),
    ("hirsizlik", "çaldı$", 3),
    ("hirsizlik", "çaldılar", 3),
    ("hirsizlik", "çalındı", 3),
    ("hirsizlik", "çalınan", 3),
    ("hirsizlik", "çalıntı", 4),
    ("hirsizlik", "çalarak", 3),
    ("hirsizlik", "çaldığı", 3),
    ("hirsizlik", "çaldıkları", 3),
    ("hirsizlik", "gasp", 4),
    ("hirsizlik", "soygun", 4),
    ("hirsizlik", "soyuldu", 4),
    ("hirsizlik", "yankesici", 4),
    ("hirsizlik", "kapkaç", 4),
    ("hirsizlik", "ziynet", 1),
    ("hirsizlik", "ele geçirildi", 1),
    ("hirsizlik", "şüpheli", 1),
    ("hirsizlik", "gözaltına", 1),
    ("hirsizlik", "yakalandı", 1),
    ("hirsizlik", "tutuklandı", 1),
    ("hirsizlik", "öldür", -5),
    ("hirsizlik", "cinayet", -5),
    ("hirsizlik", "uyuşturucu", -3),
    ("hirsizlik", "usulsüzlük", -4),
    ("hirsizlik", "rüşvet", -4),
    ("hirsizlik", "dolandırıcılık", -3),
    ("hirsizlik", "istiklal marşı", -5),
    ("hirsizlik", "kapı çal", -4),
    ("hirsizlik", "kapısını çal", -4),
    ("hirsizlik", "zil çal", -4),
    ("kultur_etkinligi", "konser$", 4),
    ("kultur_etkinligi", "konseri", 4),
    ("kultur_etkinligi", "konserde", 4),
    ("kultur_etkinligi", "konsere", 4),
    ("kultur_etkinligi", "konserler", 4),
    ("kultur_etkinligi", "konserden", 4),
    ("kultur_etkinligi", "tiyatro", 4),
    ("kultur_etkinligi", "sergi$", 3),
    ("kultur_etkinligi", "sergisi", 3),
    ("kultur_etkinligi", "sergide$", 3),
    ("kultur_etkinligi", "sergiye$", 3),
    ("kultur_etkinligi", "sergiler", 3),
    ("kultur_etkinligi", "festival", 4),
    ("kultur_etkinligi", "söyleşi", 3),
    ("kultur_etkinligi", "dinleti", 4),
    ("kultur_etkinligi", "müzikal", 3),
    ("kultur_etkinligi", "opera$", 3),
    ("kultur_etkinligi", "operası", 3),
    ("kultur_etkinligi", "operada$", 3),
    ("kultur_etkinligi", "bale$", 3),
    ("kultur_etkinligi", "resital", 4),
    ("kultur_etkinligi", "orkestra", 3),
    ("kultur_etkinligi", "koro$", 2),
    ("kultur_etkinligi", "korosu", 3),
    ("kultur_etkinligi", "kültür sanat", 3),
    ("kultur_etkinligi", "kültürel", 2),
    ("kultur_etkinligi", "etkinlik", 2),
    ("kultur_etkinligi", "sahne", 2),
    ("kultur_etkinligi", "gösterim", 2),
    ("kultur_etkinligi", "gösteri", 1),
    ("kultur_etkinligi", "sinema", 2),
    ("kultur_etkinligi", "şiir", 2),
    ("kultur_etkinligi", "imza günü", 3),
    ("kultur_etkinligi", "kitap fuar", 4),
    ("kultur_etkinligi", "fuar", 1),
    ("kultur_etkinligi", "şenlik", 3),
    ("kultur_etkinligi", "panayır", 3),
    ("kultur_etkinligi", "sanatçı", 2),
    ("kultur_etkinligi", "sanatsever", 3),
    ("kultur_etkinligi", "müze", 2),
    ("kultur_etkinligi", "atölye", 1),
    ("kultur_etkinligi", "konferans", 1),
    ("kultur_etkinligi", "kültür merkezi", 2),
    ("kultur_etkinligi", "kültür ve sanat", 3),
    ("kultur_etkinligi", "sempozyum", 3),
    ("kultur_etkinligi", "resim yarışması", 3),
    ("kultur_etkinligi", "film gösterim", 3),
    ("kultur_etkinligi", "sanat etkinli", 3),
    ("kultur_etkinligi", "kitap okuma", 2),
    ("kultur_etkinligi", "uyuşturucu", -6),
    ("kultur_etkinligi", "operasyon", -4),
    ("kultur_etkinligi", "tutuklan", -4),
    ("kultur_etkinligi", "gözaltı", -4),
    ("kultur_etkinligi", "futbol", -4),
    ("kultur_etkinligi", "transfer", -3),
    ("kultur_etkinligi", "maç$", -4),
    ("kultur_etkinligi", "maçı", -4),
    ("kultur_etkinligi", "lig$", -3),
    ("kultur_etkinligi", "aday", -3),
    ("kultur_etkinligi", "seçim", -3),
    ("kultur_etkinligi", "atama", -3),
    ("kultur_etkinligi", "atandı", -3),
]

# What a word or phrase right after a place name says of the name. (beginning of what follows, its meaning, in either case of the first letter)
#   part: names a part or a way of the place, not the place; road: a road or direction that leads there; admin: the place itself is meant
AFTER_NAME = [
    ("mahalle", "part", True),
    ("Körfezi", "part", False),
    ("istikamet", "road", True),
    ("yön", "road", True),
    ("Caddesi", "part", False),
    ("Cad.", "part", False),
    ("Sokak", "part", False),
    ("Sokağı", "part", False),
    ("Bulvar", "part", False),
    ("yolu", "road", True),
    ("karayolu", "road", True),
    ("kara yolu", "road", True),
    ("otoyolu", "road", True),
    ("köyü", "part", True),
    ("sınır", "road", True),
    ("Eğitim", "part", False),
    ("Devlet", "part", False),
    ("Şehir Hastanesi", "part", False),
    ("ilçe", "admin", True),
    ("ili", "admin_word", False),
    ("ilinde", "admin", False),
    ("Valiliği", "admin", False),
    ("Belediyesi", "admin", False),
]

# Folded line beginnings, endings and parts that make a line of a page no part of its story. (text, where it stands)
NOISE_PARTS = [
    ("abone ol", "begins"),
    ("google news", "holds"),
    ("ilgili haber", "begins"),
    ("haberin devamı", "holds"),
    ("devamı için", "holds"),
    ("tıklayın", "holds"),
    ("tıkla", "ends"),
    ("tüm haberleri", "ends"),
    ("haber albümü", "holds"),
    ("yazdır", "is"),
    ("reklam", "holds"),
    ("sponsorlu", "holds"),
    ("bizi takip", "holds"),
    ("whatsapp kanal", "holds"),
    ("kaynak :", "labels"),
    ("foto :", "labels"),
    ("fotoğraf :", "labels"),
    ("editör :", "labels"),
    ("#", "begins"),
    ("yorum yaz", "holds"),
    ("topluluk kuralları", "holds"),
    ("çerez", "holds"),
    ("cookie", "holds"),
    ("son dakika", "is"),
    ("paylaş", "is"),
]
# Lines that only name an agency.
AGENCIES = [
    "ihlas haber ajansı",
    "anadolu ajansı",
    "demirören haber ajansı",
    "haber merkezi",
    "aa",
    "iha",
    "dha",
    "anka",
    "anka haber ajansı",
]
# Elements of a page that never hold story text.
SILENT_TAGS = (
    "script style noscript iframe form button svg nav footer header aside figure figcaption video audio ins object embed select input picture img"
).split()
# Words in class or id of a block that mark it as no part of the story. (word, whole: only as a word of its own between marks)
NOISE_NAMES = [
    ("reklam", False),
    ("advert", False),
    ("ad", True),
    ("ads", True),
    ("banner", False),
    ("sponsor", False),
    ("related", False),
    ("ilgili", False),
    ("benzer", False),
    ("digerhaber", False),
    ("diger-haber", False),
    ("paylas", False),
    ("share", False),
    ("social", False),
    ("sosyal", False),
    ("comment", False),
    ("yorum", False),
    ("etiket", False),
    ("tag", True),
    ("tags", True),
    ("newsletter", False),
    ("abone", False),
    ("breadcrumb", False),
    ("author", False),
    ("yazar", False),
    ("recommend", False),
    ("outbrain", False),
    ("taboola", False),
    ("popular", False),
    ("populer", False),
    ("mostread", False),
    ("most-read", False),
    ("cokokunan", False),
    ("cok-okunan", False),
    ("sondakika-bant", False),
    ("sondakikabant", False),
    ("son-dakikabant", False),
    ("son-dakika-bant", False),
    ("googlenews", False),
    ("google-news", False),
    ("whatsapp", False),
]

# How precise a geocoder's answer of a type is: 5 address, 4 street or spot, 3 quarter, 2 road or area, 1 district, 0 province and beyond.
COMPONENT_LEVELS = {
    5: "street_address premise subpremise",
    4: "route intersection establishment point_of_interest park transit_station airport stadium",
    3: "neighborhood sublocality sublocality_level_1 sublocality_level_2 administrative_area_level_3 administrative_area_level_4 administrative_area_level_5",
    2: "natural_feature colloquial_area postal_code",
    1: "locality administrative_area_level_2",
    0: "administrative_area_level_1 country",
}
MAP_LEVELS = {
    5: "house building",
    4: "road",
    3: "neighbourhood quarter suburb village hamlet isolated_dwelling allotments",
    2: "postcode",
    1: "town city county municipality city_district district",
    0: "province state region country",
}
UNKNOWN_LEVEL = 4  # of a type that MAP_LEVELS lacks
DISTRICT_FIELDS = "town county city_district municipality city district".split()  # tried in this order
