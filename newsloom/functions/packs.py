"""Rule packs: the words and patterns that classification and scoring go by, as data.

Operators take a pack as a parameter. ``CITY`` is the pack of the city newsroom; ``CORPUS`` has
the same shape with words of an English test corpus, so that rules can be exercised there.
Patterns are matched with the flags of :func:`newsloom.functions.text.matches_any`.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Pack:
    """Everything that depends on the language and the place."""

    word: str  # a token of a signature
    official: tuple[str, ...]  # patterns of official attribution
    official_not: tuple[str, ...]  # patterns that undo it
    regional: tuple[str, ...]  # names of regional media
    nonlocal_: tuple[str, ...]
    local: tuple[str, ...]
    opinion: tuple[str, ...]
    opinion_pattern: str
    help: tuple[str, ...]
    help_pattern: str
    help_event: tuple[str, ...]  # events that keep a plea for help news
    phone: str
    listing: str
    complaint: tuple[str, ...]
    news: tuple[str, ...]
    excluded: tuple[str, ...]
    promo: tuple[str, ...]
    promo_patterns: tuple[str, ...]
    anchors: tuple[str, ...]
    same_event: tuple[str, tuple[str, ...]]  # a place's stem, stems of what happened
    same_number: str
    strong_event: tuple[str, ...]
    hooks: tuple[tuple[int, tuple[str, ...]], ...]
    local_name: str
    local_scoring: tuple[str, ...]
    fatal: tuple[str, ...]
    events: tuple[tuple[str, tuple[str, ...], float], ...]
    interview: str
    sport: str
    announcement: str
    features: tuple[tuple[str, tuple[str, ...]], ...]
    stopwords: tuple[str, ...]
    suffixes: tuple[str, ...]
    story_word: str
    shown_excluded: tuple[str, ...]  # narrower lists of the diagnostics
    shown_promo: tuple[str, ...]


# The words, patterns and impacts that results depend on.
CITY = Pack(
    word=r"[а-яёa-z0-9]{4,}",
    official=(
        r"\bпрокуратур\w*\s+(?:сообщил|заявил|выявил|проверил|установил|внёс|вынес|потребовал)",
        r"\bпо данным прокуратур\w*", r"\bследственн\w+\s+комитет\w*\s+(?:сообщил|начал|возбудил|проводит|расследует)",
        r"\bск\s+(?:сообщил|начал|возбудил|проводит|расследует)", r"\bмчс\s+(?:сообщил|предупредил|рассказал)",
        r"\bгибдд\s+(?:сообщил|предупредил|рассказал)", r"\bсуд\s+(?:вынес|назначил|арестовал|приговорил|рассмотрел)",
        r"\bадминистраци\w*\s+(?:сообщил|рассказал|объявил|предупредил)",
        r"\bправительств\w+\s+омск\w*\s+(?:сообщил|объявил|утвердил|принял)",
        r"\bофициально\s+(?:сообщил|подтвердил|заявил)",
        r"\b(?:приказ|распоряжени\w*)\s+(?:подписал|подписано|утвержд\w*)",
        r"\b(?:мэрия|администраци\w*|департамент\w*)\s+(?:сообщил|заявил|подтвердил|объявил|сообщает)",
        r"\b(?:директор|руководител\w*)\s+(?:департамент\w*|администраци\w*)\s+(?:подписал|утвердил)",
        r"\bсоответствующ\w+\s+(?:приказ|распоряжени\w*)",
        r"\bпо данным следств\w*", r"\bпо данным ск\b", r"\bпо данным полиции\b", r"\bпо данным мвд\b",
        r"\bпо данным угмс\b", r"\bпо данным ведомств\w*", r"\bследств\w*\s+(?:установил|сообщил|выясняет|расследует)",
        r"\bобь-иртышск\w+\s+угмс", r"\bугмс\b",
    ),
    official_not=(
        r"официальн\w*\s+информаци\w*\s+(?:пока\s+)?(?:нет|не\s+поступ)",
        r"официальн\w*\s+информаци\w*\s+не\s+(?:подтвержден|поступил)",
        r"официальн\w*\s+подтверждени\w*\s+нет",
        r"официальн\w*\s+информаци\w*.*?пока\s+не\s+поступ",
    ),
    regional=(
        "om1", "om1.ru", "ngs55", "superomsk", "kvnews", "омскинформ", "omskinform", "lenta novostey",
        "лента новостей омск", "gtrk irtysh", "гтрк иртыш", "novy omsk", "новый омск", "aif omsk", "аиф омск",
        "omskregion.info", "sibir041", "omsk55", "омсми",
    ),
    nonlocal_=(
        "иркутской области", "иркутск", "краснодарского края", "краснодар", "бурятии", "бурятия", "москва", "москве",
        "санкт-петербург", "екатеринбург", "тюмени", "тюменской области", "новосибирске", "новосибирской области",
        "красноярске", "красноярского края",
    ),
    local=("омск", "омской области", "омская область", "омском", "омские", "омский", "тара", "калачинск", "исилькуль"),
    opinion=(
        "наш любимый омск", "бравурных репортажей", "можете задонатить", "по большому секрету", "прорывная команда",
        "клоунада", "позор", "авангардный рывок", "только вот незадача", "пропиаренных", "какие плюшки", "омичей травят",
        "а где эти", "ну и да, если кто", "давайте подумаем", "разве можно так относиться", "куда смотрят инспекторы",
    ),
    opinion_pattern=r"(?:\?|!!!).*(?:где|почему|зачем|какие|сколько|разве|куда)",
    help=(
        "просьба о помощи", "к кому обращаться", "что нам делать", "может кто видел", "может кто-нибудь видел",
        "хотел бы найти владельца", "хотел найти владельца", "нужны записи", "есть записи с видео регистратора",
        "есть записи с видеорегистратора", "записи с видео регистратора", "опубликуйте, пожалуйста", "опубликуйте пожалуйста",
        "уважаемые автолюбители", "огромная просьба", "пожалуйста, напишите", "пожалуйста напишите", "прошу найти",
        "просим найти", "записи видеорегистратора", "если у кого-то есть запись", "если у кого есть запись",
        "ищем очевидцев", "найти очевидцев", "поиск очевидцев", "просьба откликнуться", "ищет дом", "ищет хозяина",
        "ищет хозяев", "нужен дом", "нужен хозяин", "нужны хозяева", "заберите домой", "готовы забрать", "возьмите домой",
        "приют", "передержк", "нужна помощь", "нужна финансовая помощь", "сбор средств", "собрать деньги", "помочь животн",
        "помочь собак", "помочь кошк", "сделайте репост", "репост — шанс", "репост это шанс",
    ),
    help_pattern=(
        r"(?:опубликуйте|огромная просьба|просьба о помощи|к кому обращаться|что нам делать|может кто(?:-нибудь)? видел|"
        r"пожалуйста.{0,25}(?:запис|напиш|отклик)|просим|прошу|хотел(?: бы)? найти).{0,160}"
        r"(?:очевидц|видеорегистратор|запис|помощь|владельц)"
    ),
    help_event=(
        "пропал", "пропала", "пропали", "разыскива", "погиб", "погибла", "погибли", "умер", "пожар", "дтп", "авари",
        "столкнул", "задержан", "возбуждено уголовное дело",
    ),
    phone=r"(?:\+?7|8)?\s*\(?\d{3}\)?[\s-]*\d{3}[\s-]*\d{2}[\s-]*\d{2}",
    listing=(
        r"(?:пристро\w*|отда\w*\s+(?:в\s+добрые\s+руки|кот\w*|кош\w*|животн\w*)|ищ\w*\s+дом|забрать\s+домой|кот\w*\s+барсик)"
    ),
    complaint=(
        "жители жалуются", "жители пожаловались", "омичи жалуются", "омичи пожаловались", "жалоба жителей",
        "сообщают жители", "по словам жителей", "очевидцы сообщают", "вопрос к гаи", "куда смотрят инспекторы",
        "сколько это будет продолжаться", "почему нет", "почему отключили", "не работает", "не убирают", "не убрали",
        "льётся вода", "течёт вода", "нет отопления", "нет горячей воды", "нет газа", "дети мёрзнут", "всё перекопали",
        "разве можно так относиться",
    ),
    news=(
        "произош", "произошла", "произошло", "сообщил", "сообщили", "задержан", "задержали", "возбуждено уголовное дело",
        "уголовное дело", "погиб", "погибла", "погибли", "умер", "умерла", "пожар", "загорелся", "авари", "дтп", "столкнул",
        "суд", "приговор", "арестовал", "взрыв", "выброс", "превысил норм", "тариф", "отключ", "закрыли", "открыли", "введут",
        "изменят", "проверка", "прокуратура", "следственный комитет", "мчс", "гибдд", "администрация",
    ),
    excluded=(
        "бпла", "беспилот", "дрон", "дроны", "дрона", "дронами", "воздушн", "тревог", "ракетн", "опасност", "пво",
    ),
    promo=(
        "подписывайтесь", "подпишитесь", "подписывайся", "наши каналы", "самые свежие новости",
        "где публикуются самые свежие", "публикуем в нашем канале", "актуальную информацию", "в режиме онлайн",
        "следим за обстановкой", "ищите по запросу", "вся оперативная информация", "на правах рекламы",
        "партнёрский материал", "партнерский материал", "спецпроект компании", "брендированный материал",
        "благодаря поддержке предприятия", "благодаря поддержке компании", "при поддержке предприятия",
        "при поддержке компании", "программа «родные города»", 'программа "родные города"', "копирование тарифа",
        "перейдите со своим номером", "перейти от любого оператора", "сохранить номер и привычные условия",
        "предложение от мегафона",
    ),
    promo_patterns=(
        r"\b(?:реклама|рекламный материал|партнёрский материал|партнерский материал)\b",
        r"\b(?:скидк\w*|промокод\w*|купить|покупайте|закажите|оформите заказ)\b",
        r"\b(?:благодаря|при) поддержк\w+ (?:омск\w* нпз|предприяти\w*|компани\w*|бренд\w*)",
        r"\bпрограмма\s+[«\"]?родные города[»\"]?",
        r"\b(?:новом видеопроекте|смотрите видео о переменах)\b",
        r"\b(?:бесплатно )?перейдите? со своим номером\b",
        r"\bперейти от любого оператора\b",
        r"\b(?:опция|предложение)\s+[«\"]?копирован\w*\s+тариф\w*",
    ),
    anchors=(
        "прокуратур", "мчс", "гибдд", "суд", "погиб", "умер", "пожар", "авари", "выброс", "тариф", "мошен", "школ", "столов",
        "возгора", "теплотрас", "кипят",
    ),
    same_event=("школ", ("пожар", "горел", "возгора")),
    same_number=r"\b(?:№\s*)?\d+\b",
    strong_event=("рабоч", "теплов", "кипят", "ожог", "уголовн", "гибел", "гагарин"),
    hooks=(
        (18, ("снесут", "запрет", "пропал", "погиб", "задержали", "авар", "пожар", "дтп")),
        (12, ("почему", "как так", "куда смотр", "что будет", "впервые", "необыч")),
        (10, ("омск", "омской", "омич", "омичи")),
    ),
    local_name="омск",
    local_scoring=("омск", "омской", "омич", "омичи", "тара", "черлак", "калачинск", "исилькуль"),
    fatal=(
        r"\bпогиб(?:ла|ли|ло)?\s+(?:\d+\s+)?(?:человек|людей|мужчин\w*|женщин\w*|реб[её]нок|дети|водител\w*|пассажир\w*|"
        r"рабоч\w*|сотрудник\w*|полицейск\w*)",
        r"\b(?:человек|мужчин\w*|женщин\w*|реб[её]нок|дети|водител\w*|пассажир\w*)\b.{0,40}\bпогиб\w*",
        r"\bсмертельн\w*\s+(?:дтп|авари\w*|происшеств\w*|столкновен\w*|наезд\w*)",
        r"\bумер(?:ла|ли)?\s+(?:человек|мужчин\w*|женщин\w*|реб[её]нок|пациент\w*)",
        r"\bскончал(?:ся|ась|ись)\b",
    ),
    events=(
        ("public_safety", ("эвакуир", "эвакуац", "угроз", "минирован", "подозрительн предмет", "закрыли здание"), 85.0),
        ("major_incident", ("взрыв", "обруш", "крушен", "крупн авар", "массов", "разрушен"), 90.0),
        ("fire_or_emergency", ("пожар", "горит", "загорел", "возгора", "спасател"), 75.0),
        ("transport_incident", ("дтп", "столкновен", "сбил", "наезд", "перекрыт", "закрыли дорогу"), 65.0),
        ("missing_person", ("пропал", "пропала", "пропали", "разыскива"), 55.0),
        ("public_decision", (
            "повысили тариф", "изменят тариф", "запрет", "вступит в силу", "приняли закон", "отменили маршрут",
            "закроют маршрут",
        ), 45.0),
    ),
    interview=r"\b(?:интервью|рассказал\w*|поделил\w*\s+впечатлен\w*|после\s+матча)\b",
    sport=r"\b(?:хокке\w*|авангард\w*|футбол\w*|спортсмен\w*|матча|игрок\w*|голкипер\w*)\b",
    announcement=r"\b(?:автограф-сесси\w*|анонс\w*\s+мероприят\w*|состоится\s+(?:концерт|встреча|мероприятие|автограф))",
    features=(
        ("incident", ("авари", "дтп", "пожар", "взрыв", "погиб", "пострад", "спасател")),
        ("crime", ("полици", "суд", "следств", "подозрева", "арест", "мошен", "украл", "штраф")),
        ("transport", ("дорог", "маршрут", "автобус", "трамва", "перекрест", "движени", "мост")),
        ("weather", ("погод", "снег", "дожд", "мороз", "тепл", "ветер", "гололед")),
        ("city_services", ("ремонт", "отключ", "вода", "отоплен", "благоустрой", "мусор", "коммунал")),
        ("public_decision", ("мэр", "губернатор", "власти", "решили", "закон", "тариф", "запрет")),
        ("sports", ("авангард", "хоккей", "матч", "спорт", "гол", "игрок")),
        ("culture", ("театр", "концерт", "выставк", "фестиваль", "музей", "памятник")),
    ),
    stopwords=(
        "омск", "област", "регион", "город", "район", "новост", "публикац", "информац", "источник", "сообщ", "заяв",
        "канал", "виде", "ролик", "сайт", "редакц", "сегодня", "вчера", "сейчас", "полици", "следств", "данн", "автор",
        "человек", "мужчин", "женщин", "котор", "сам",
    ),
    suffixes=(
        "иями", "ями", "ами", "ирует", "ировать", "оваться", "ого", "его", "ому", "ему", "ыми", "ими", "ая", "яя", "ое",
        "ее", "ые", "ие", "ую", "юю", "ов", "ев", "ей", "ам", "ям", "ах", "ях", "ом", "ем", "ой", "ий", "ый", "а", "я", "ы",
        "и", "е", "у", "ю", "ь", "й", "ся", "сь", "ет", "ит", "ют", "ут", "ят", "ать", "ить", "ять", "ешь", "ишь", "лся",
        "лась", "лись", "ясь",
    ),
    story_word=r"[a-zа-я0-9]+",
    shown_excluded=(
        "бпла", "беспилотник", "беспилотники", "беспилотный", "беспилотные", "дрон", "дроны", "дрона", "дронами",
        "воздушная тревога", "воздушной тревоги", "ракетной опасности",
    ),
    shown_promo=(
        "подписывайтесь", "подпишитесь", "подписывайся", "наши каналы", "самые свежие новости",
        "где публикуются самые свежие",
    ),
)

#: The same rules with words of the synthetic English test corpus.
CORPUS = Pack(
    word=r"[a-z0-9à-öø-ÿœ]{4,}",
    official=(r"\bthe\s+and\s+attion\b", r"\bof\s+the\s+and\b"),
    official_not=(r"\bnot\s+the\b",),
    regional=("src1", "src3"),
    nonlocal_=("ouvi", "keit"),
    local=("thou", "ation"),
    opinion=("idiot", "clown"),
    opinion_pattern=r"(?:\?|!!!).*(?:the|and)",
    help=("+1 (", "example.com"),
    help_pattern=r"(?:this|that).{0,40}(?:onthe|ering)",
    help_event=("ering", "heing"),
    phone=r"\+1 \(\d{3}\) \d{3}-\d{4}",
    listing=r"\bthe\w*\s+of\b",
    complaint=("loser", "moron", "trash"),
    news=("tion", "ung"),
    excluded=("password", "secret"),
    promo=("licensed under", "all rights reserved"),
    promo_patterns=(r"\blicense\w*\b", r"\bcopyright\b"),
    anchors=("thou", "ering", "heit", "ción"),
    same_event=("thou", ("ering", "heing")),
    same_number=r"\b\d+\b",
    strong_event=("thou", "ering", "ation", "heit"),
    hooks=((18, ("idiot", "trash")), (12, ("thou", "heing")), (10, ("the", "und"))),
    local_name="thou",
    local_scoring=("thou", "ation"),
    fatal=(r"\bidiot\s+the\b",),
    events=(
        ("public_safety", ("scum", "moron"), 85.0),
        ("major_incident", ("trash",), 90.0),
        ("fire_or_emergency", ("ering", "heing"), 75.0),
        ("transport_incident", ("keit",), 65.0),
        ("missing_person", ("ouvi",), 55.0),
        ("public_decision", ("ción",), 45.0),
    ),
    interview=r"\b(?:was|are)\b",
    sport=r"\bfor\b",
    announcement=r"\bder\s+die\b",
    features=(
        ("incident", ("idiot", "trash")),
        ("crime", ("secret", "password")),
        ("transport", ("thou",)),
        ("weather", ("heit",)),
        ("city_services", ("keit",)),
        ("public_decision", ("ering",)),
        ("sports", ("ción",)),
        ("culture", ("eux",)),
    ),
    stopwords=("that", "this", "with", "thou"),
    suffixes=("tion", "ing", "ers", "ed", "er", "es", "s"),
    story_word=r"[a-z0-9]+",
    shown_excluded=("password", "secret"),
    shown_promo=("licensed under",),
)
