"""Word lists, phrase patterns and thresholds that results depend on."""

# Call-to-action phrases, matched on normalised text.
CTA_PATTERNS = [
    r"thanks?\s+(?:\S+\s+){0,4}?for\s+watching",
    r"\bsubscribe\b",
    r"\bunsubscribe\b",
    r"\bsubscribing\b",
    r"hit\s+the\s+(?:like|bell|subscribe)",
    r"smash\s+th(?:at|e)\s+(?:like|subscribe)",
    r"like\s+and\s+(?:share|subscribe)",
    r"like\s+comment",
    r"leave\s+a\s+(?:like|comment)\b",
    r"drop\s+a\s+like\b",
    r"see\s+you\s+(?:all\s+|guys\s+)?(?:in\s+the\s+)?next",
    r"link\s+in\s+(?:the\s+)?(?:bio|description)",
    r"links?\s+(?:down\s+)?below\b",
    r"in\s+the\s+description\s+below",
    r"\bsponsored?\b",
    r"\bsponsors?\b",
    r"brought\s+to\s+you\s+by",
    r"welcome\s+back\s+to\s+(?:the\s+|my\s+)?channel",
    r"don\s?t\s+forget\s+to\s+(?:like|subscribe|follow|comment|hit|smash)",
    r"notification\s+bell",
    r"(?:hit|ring|tap)\s+th(?:at|e)\s+bell",
    r"turn\s+on\s+(?:post\s+|the\s+)?notifications?\b",
    r"use\s+(?:my|the)\s+code\b",
    r"(?:promo|discount|coupon)\s+code",
    r"\bpatreon\b",
    r"\bgiveaway\b",
    r"\bmerch\b",
    r"follow\s+me\s+on\b",
    r"check\s+out\s+my\b",
    r"if\s+you\s+enjoyed\s+(?:this|the)\s+video",
    r"đăng\s+ký\s+kênh",
    r"(?:nhấn|bấm|ấn)\s+(?:nút\s+)?đăng\s+ký",
    r"(?:nhấn|bật|bấm)\s+(?:cái\s+)?chuông",
    r"like\s+(?:và\s+|va\s+)?share",
    r"like\s+share",
    r"cảm\s+ơn\s+(?:\S+\s+){0,4}?đã\s+(?:xem|theo\s+dõi|đồng\s+hành|ủng\s+hộ)",
    r"hẹn\s+gặp\s+lại",
    r"ủng\s+hộ\s+kênh",
    r"chào\s+mừng\s+(?:\S+\s+){0,4}?(?:quay\s+trở\s+lại|đến\s+với\s+kênh)",
    r"video\s+(?:lần\s+)?(?:sau|tiếp\s+theo|kế\s+tiếp)",
    r"tài\s+trợ",
    r"quảng\s+cáo",
    r"チャンネル登録",
    r"登録(?:お願い|よろしく|ボタン)",
    r"高評価",
    r"グッドボタン",
    r"いいねボタン",
    r"通知(?:オン|設定|ボタン)",
    r"ベルマーク",
    r"概要欄",
    r"スパチャ",
    r"メンバーシップ",
    r"ご?視聴(?:ありがとう|いただき)",
    r"次の動画で",
    r"구독\s*(?:과\s*)?좋아요",
    r"좋아요\s*(?:와\s*)?구독",
    r"구독\s*(?:버튼|부탁|눌러)",
    r"알림\s*설정",
    r"시청해\s*주셔서\s*감사",
    r"다음\s*영상에서",
    r"订阅",
    r"訂閱",
    r"点赞",
    r"點讚",
    r"一键三连",
    r"感谢观看",
    r"感謝觀看",
    r"下[期个個]视频",
    r"下[期个個]影片",
    r"记得关注",
    r"点个关注",
    r"关注我的频道",
    r"\bsuscr[ií]b",
    r"dale\s+(?:al\s+)?like",
    r"gracias\s+por\s+ver",
    r"activa\s+la\s+campanita",
    r"(?:link|enlace)\s+en\s+la\s+descripci[oó]n",
    r"nos\s+vemos\s+en\s+(?:el\s+)?pr[oó]ximo",
    r"\bse\s+inscrev",
    r"\binscrevam?\s+se\b",
    r"deixa\s+o\s+like",
    r"obrigad[oa]\s+por\s+assistir",
    r"ativa\s+o\s+sininho",
    r"link\s+na\s+descri[cç][aã]o",
    r"at[eé]\s+o\s+pr[oó]ximo\s+v[ií]deo",
    r"abonnez\s+vous",
    r"abonne\s+toi",
    r"vous\s+abonner",
    r"pouce\s+bleu",
    r"lien\s+en\s+description",
    r"petite\s+cloche",
    r"merci\s+d\s+avoir\s+regard[eé]",
    r"la\s+prochaine\s+vid[eé]o",
    r"\babonnier",
    r"daumen\s+hoch",
    r"glocke\s+aktivier",
    r"danke\s+f[uü]rs?\s+zuschauen",
    r"bis\s+zum\s+n[aä]chsten\s+video",
    r"link\s+in\s+der\s+beschreibung",
    r"подписывайтесь",
    r"подпишись",
    r"подписаться\s+на\s+канал",
    r"(?:ставь|поставь)(?:те)?\s+лайк",
    r"колокольчик",
    r"спасибо\s+за\s+просмотр",
    r"в\s+следующем\s+видео",
    r"ссылка\s+в\s+описании",
]

# Channel greetings.
GREETING_PATTERNS = [
    r"what\s?s\s+up\s+guys",
    r"what\s+is\s+up\s+guys",
    r"welcome\s+back\b",
    r"welcome\s+to\s+(?:the\s+|my\s+)?(?:channel|video)",
    r"hey\s+(?:guys|everyone|everybody|y\s?all)\b",
    r"\bhi\s+guys\b",
    r"hello\s+(?:everyone|everybody|guys)\b",
    r"in\s+today\s?s\s+video",
    r"xin\s+chào\s+(?:tất\s+cả\s+)?(?:các\s+bạn|anh\s+em|mọi\s+người)",
    r"chào\s+mừng\s+các\s+bạn",
    r"(?:みな|皆)さん\s*こんにちは",
    r"どうも\s*(?:みな|皆)さん",
    r"今日の動画",
    r"今回の動画",
    r"안녕하세요\s*여러분",
    r"여러분\s*안녕하세요",
    r"大家好",
    r"hola\s+a\s+todos",
    r"bienvenidos\s+al?\b",
    r"salut\s+[aà]\s+tous",
    r"bonjour\s+[aà]\s+tous",
    r"hallo\s+(?:leute|zusammen)",
    r"willkommen\s+zur[uü]ck",
    r"всем\s+привет",
    r"привет\s+всем",
]

# Sponsor reads and channel housekeeping.
PROMO_PATTERNS = [
    r"sponsored\s+by\b",
    r"today\s?s\s+(?:video\s+)?sponsor",
    r"(?:this|the)\s+(?:video|episode)\s+is\s+(?:brought|sponsored)",
    r"for\s+sponsoring\b",
    r"\bsponsors?\s+of\s+(?:this|today)\b",
    r"\bad\s+break\b",
    r"quick\s+word\s+from\s+(?:our|the)\s+sponsor",
    r"before\s+we\s+(?:continue|get\s+started|start|jump|dive)(?:\s+\w+){0,4}?\s+make\s+sure",
    r"real\s+quick\s+before\b",
    r"(?:my|our)\s+second\s+channel",
    r"my\s+other\s+channel",
    r"(?:my|our)\s+(?:last|previous)\s+video\b(?!\s*game)",
    r"(?:in|from)\s+(?:the\s+|my\s+|our\s+)?(?:last|previous)\s+video\b(?!\s*game)",
    r"previous\s+video\b(?!\s*game)",
    r"if\s+you\s+missed\s+(?:the\s+|my\s+|our\s+)?(?:last|previous)\s+(?:video|episode|stream|one)",
    r"in\s+case\s+you\s+missed\s+it",
    r"(?:we|i|the\s+channel)\s+(?:just\s+)?(?:hit|reached|crossed)\s+(?:\S+\s+){0,3}?(?:subscribers|subs)\b",
    r"\d+\s*(?:k|thousand|million)?\s*subscriber\s+special",
    r"(?:subscriber|channel)\s+milestone",
    r"road\s+to\s+(?:\S+\s+){0,2}?(?:subs|subscribers)",
    r"giveaway\s+winners?\b",
    r"shout\s?outs?\s+to\b",
    r"thank\s+you\s+to\s+(?:all\s+)?(?:my|our)\s+patrons",
    r"(?:my|our)\s+patrons\b",
    r"join\s+(?:my|our|the)\s+discord",
    r"video\s+trước\b",
    r"kênh\s+phụ\b",
    r"nhà\s+tài\s+trợ",
    r"スポンサー",
    r"提供でお送り",
    r"案件",
    r"プロモーション(?:を)?含",
    r"前回の動画",
    r"別チャンネル",
    r"サブチャンネル",
    r"登録者\s?\d+\s?万人",
    r"銀の盾",
    r"本編に入る前に",
    r"스폰서",
    r"협찬",
    r"유료\s*광고",
    r"지난\s*영상",
    r"구독자\s*\d+\s*만",
    r"赞助",
    r"贊助",
    r"恰饭",
    r"上[期个個]视频",
    r"上[期个個]影片",
    r"粉丝破",
    r"粉絲破",
    r"patrocinad",
    r"el\s+patrocinador",
    r"v[ií]deo\s+anterior",
    r"segundo\s+canal",
    r"mi\s+otro\s+canal",
    r"ganador(?:es)?\s+del\s+sorteo",
    r"sponsoris[eé]",
    r"en\s+partenariat\s+avec",
    r"vid[eé]o\s+pr[eé]c[eé]dente",
    r"ma\s+(?:seconde|deuxi[eè]me)\s+cha[iî]ne",
    r"gesponsert",
    r"enth[aä]lt\s+werbung",
    r"im\s+letzten\s+video",
    r"zweiten?\s+kanal",
    r"mein\s+anderer\s+kanal",
    r"\bспонсор",
    r"промокод",
    r"в\s+прошлом\s+видео",
    r"второй\s+канал",
]

# English function words used to tell English speech.
ENGLISH_FUNCTION_WORDS = (
    "the and you that this not with for have was are but what all just your like know get going "
    "gonna yeah okay right out about she her him his they them then when how who can will would "
    "been from one because really think want time now got here there were did let see come back "
    "good well it's i'm don't that's we're he's she's you're"
).split()

# Personal pronouns, all folded to one token.
PRONOUNS = (
    "i me my mine myself he him his himself she her hers herself we us our ours ourselves they "
    "them their theirs themselves you your yours yourself yourselves it its itself tôi toi tao ta "
    "tớ to mình minh anh chị chi em hắn han cô co chú chu bác bac ông ong bà ba nó no họ ho cậu "
    "cau gã ga y thị thi"
).split()

# Stop words (Vietnamese, English, Hindi).
STOP_VI = (
    "và hay hoặc nhưng mà thì là của ở trong trên dưới tại cho với từ được bị này kia đó những "
    "các một hai ba không có làm rồi đã đang sẽ cũng rất quá lắm luôn nhé nha ạ ơi à ừ anh chị em "
    "ông bà cô chú nó họ tôi ta bạn mình chúng gì sao khi nào đây đấy ai để vì nên còn lại ra vào "
    "lên xuống cái con người việc chuyện lúc bây giờ nữa thôi đi đến về như vậy thế nếu thật sự "
    "ấy hắn cả chỉ mới vừa ngay sau trước"
).split()
STOP_EN = (
    "the a an and or but so of to in on at for with from by as is are was were be been being it "
    "its this that these those he she they them we you i me his her their our my your not no nor "
    "do does did done will would shall should can could may might must have has had having just "
    "very really then than there here what when where which who whom whose why how all any some "
    "more most other another into over under after before again once out up down off only own "
    "same too also about because while if else even still yet going go get got one two"
).split()
STOP_HI = (
    "का की के को से में ने पर और भी ही तो या है हैं था थी थे हो होगा होगी होंगे हुआ हुई हुए कर "
    "करके रहा रही रहे गया गई गए यह वह इस उस ये वो जो कि अब जब तब क्या कौन क्यों कैसे कहाँ नहीं "
    "मैं हम तुम आप वे मेरा मेरी मेरे उसका उसकी उसके उनका उनकी उनके अपना अपनी अपने इसका इसकी इसके "
    "एक दो कुछ सब बहुत लिए साथ बाद पहले फिर ओर तरह बात वाला वाली वाले"
).split()

# Words never emphasised in captions.
CAPTION_STOP = (
    "the a an and or but of to in on at is are was were be been am i you he she it we they me my "
    "your his her our their this that these those for with as so do does did have has had will "
    "would can could just not no yes if then than out up off get got too very also là và của một "
    "các có không được người này đó cho khi với thì mà ở ra vào rồi đã đang sẽ bị cũng nữa lại "
    "nên cứ chỉ đi nhé ạ à ơi cái con những rất quá thôi luôn vẫn còn từ về theo cùng hay hoặc "
    "nhưng vì do bởi tôi tao tớ mình em anh chị mày nó họ ta chúng ông bà cô chú bác ai gì"
).split()

# Letters found only in Vietnamese.
VIETNAMESE_LETTERS = "ăằắẳẵặầấẩẫậđềếểễệồốổỗộơờớởỡợưừứửữựạảẹẻẽịỉĩọỏụủũỹỵỷỳ"

# Phrases recognisers invent when nobody speaks.
INVENTED_PHRASES = [
    "thank you",
    "thanks for watching",
    "subscribe",
    "subtitles by",
    "amara.org",
    "please subscribe",
    "bye bye",
    "music",
    "applause",
    "字幕",
    "ご視聴",
    "チャンネル登録",
    "감사합니다",
    "구독",
    "cảm ơn",
    "đăng ký kênh",
    "phụ đề",
]

# Language names met in stored labels.
LANGUAGE_NAMES = {
    "vietnamese": "vi", "tiếng việt": "vi", "tieng viet": "vi", "english": "en", "tiếng anh": "en",
    "japanese": "ja", "tiếng nhật": "ja", "korean": "ko", "tiếng hàn": "ko", "chinese": "zh",
    "tiếng trung": "zh", "thai": "th", "tiếng thái": "th", "french": "fr", "tiếng pháp": "fr",
    "spanish": "es", "tiếng tây ban nha": "es", "german": "de", "tiếng đức": "de", "russian": "ru",
    "tiếng nga": "ru", "indonesian": "id", "tiếng indonesia": "id", "portuguese": "pt",
    "italian": "it", "tiếng ý": "it", "arabic": "ar", "tiếng ả rập": "ar", "hindi": "hi",
    "dutch": "nl", "tiếng hà lan": "nl", "turkish": "tr", "tiếng thổ nhĩ kỳ": "tr", "polish": "pl",
    "tiếng ba lan": "pl", "lao": "lo", "tiếng lào": "lo", "khmer": "km", "tiếng khmer": "km",
    "burmese": "my", "myanmar": "my", "tiếng miến điện": "my",
}

# Fixed value: what the note of an expired claim is given at its end.
CLAIM_EXPIRED = " [gián đoạn - app tắt giữa chừng?]"

# Effects by the kind of moment, in order of preference.
EFFECTS_BY_KIND = {
    "peak": ("zoom_nhoi", "rung_lac", "sh_tuong_phan", "loe_sang", "nhay_sang", "tuong_phan", "meo_kinh"),
    "action": ("glitch_khoi", "o_vuong", "xao_dong", "lech_bang", "vien_net", "dong_quet", "song_meo"),
    "still": ("quang_sang", "hat_phim", "sh_toi_vien", "toi_vien", "sh_hat_phim", "nhieu_analog", "hat_nhieu", "vien_phim"),
    "close": ("sup_toi", "nhay_sang", "sh_toi_vien", "toi_vien", "quang_sang", "zoom_nhoi", "vien_phim"),
    "join": ("mo_net", "loe_sang", "o_vuong", "mo_vuong", "lech_bang", "zoom_nhoi", "dem_nguoc"),
    "plain": ("quang_sang", "hat_phim", "sh_hat_phim", "nhieu_analog", "dong_quet", "toi_vien", "zoom_day", "hat_nhieu", "tuong_phan", "sh_tuong_phan"),
    "opening": ("zoom_nhoi", "loe_sang", "tuong_phan", "rung_lac", "nhay_sang"),
}

# Length of each effect in milliseconds.
EFFECT_MS = {
    "zoom_nhoi": 400, "zoom_day": 700, "rung_lac": 450, "loe_sang": 300, "sup_toi": 350, "nhay_sang": 500, "tuong_phan": 400, "o_vuong": 320,
    "xao_dong": 300, "glitch_khoi": 350, "lech_bang": 400, "dong_quet": 450, "nhieu_analog": 500, "quang_sang": 600, "hat_phim": 600,
    "hat_nhieu": 500, "toi_vien": 700, "vien_phim": 700, "mo_net": 350, "mo_vuong": 350, "vien_net": 350, "meo_kinh": 450, "song_meo": 500,
    "dem_nguoc": 800, "sh_hat_phim": 600, "sh_toi_vien": 700, "sh_tuong_phan": 400,
}

# Bounds of an effect plan in milliseconds and percent, and the peak over the median below which a clip counts as flat.
EFFECT_SHORTEST, EFFECT_LONGEST, EFFECT_APART, EFFECT_SHARE, FLAT_RANGE = 300, 800, 2500, 10, 1.35
OPENING_AT, OPENING_LONGEST, OPENING_CLIP = 120, 450, 3000
EFFECTS_BY_LEVEL = {"light": 2, "medium": 3, "strong": 3}
