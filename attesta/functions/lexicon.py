"""Names, thresholds, texts and patterns that results depend on, stated as they have to be."""

# The nine indicators in their order, and the context of a row.
INDICATORS = [
    "overconfidence", "underconfidence", "strategic_help", "cognitive_avoidance", "productive_struggle",
    "unproductive_frustration", "lucky_guess", "slipping", "boredom_offtask",
]
TRIAD = ["underconfidence", "productive_struggle", "lucky_guess"]
SIMPLE = ["overconfidence", "strategic_help", "cognitive_avoidance", "unproductive_frustration", "slipping", "boredom_offtask"]

# Thresholds.
HINT_ZERO = 1e-6
HIGH = 0.5
WEAK = 0.5 * 0.3
SC_BAND = 0.15

# Bin edges.
LAG_EDGES = [0, 60, 300, 900, 1800, 3600, 10800, 86400, 259200, 604800]
ELAPSED_EDGES = [0, 2, 5, 10, 20, 30, 60, 120, 300, 600]
ATTEMPT_EDGES = list(range(11))

# Category of each indicator.
CATEGORY = {
    "overconfidence": "Monitoring",
    "underconfidence": "Monitoring",
    "strategic_help": "Regulation",
    "cognitive_avoidance": "Regulation",
    "productive_struggle": "Struggle",
    "unproductive_frustration": "Affective",
    "boredom_offtask": "Affective",
    "lucky_guess": "Reliability",
    "slipping": "Reliability",
}

# What a strong signal of each indicator means.
DESCRIPTION = {
    "ko": {
        "overconfidence": "학생이 실제 자신의 이해 수준보다 더 높은 자신감을 보이며 과도하게 확신했다.",
        "underconfidence": "학생이 실제 자신의 이해 수준보다 낮은 자신감을 보이며 스스로를 과소평가했다.",
        "strategic_help": "학생이 필요한 순간에 힌트를 전략적으로 잘 활용했다.",
        "cognitive_avoidance": "학생이 어려운 문제나 도움 요청을 회피하려는 경향을 보였다.",
        "productive_struggle": "학생이 힌트를 사용하며 어려움을 겪으면서도 생산적으로 분투한 끝에 문제를 해결했다.",
        "unproductive_frustration": "학생이 반복적인 실패나 어려움 속에서 비생산적인 좌절감을 느꼈다.",
        "lucky_guess": "학생이 문제를 제대로 이해하지 못한 채 우연히 정답을 맞혔다.",
        "slipping": "학생이 이전에는 잘 이해하고 있던 내용에서 뜻밖의 실수를 저질렀다.",
        "boredom_offtask": "학생이 지루함을 느끼며 과제에서 벗어난 행동을 보였다.",
    },
    "en": {
        "overconfidence": "The student showed excessive confidence, higher than their actual level of understanding warranted.",
        "underconfidence": "The student showed lower confidence than their actual level of understanding warranted, underestimating themselves.",
        "strategic_help": "The student made good strategic use of hints exactly when they were needed.",
        "cognitive_avoidance": "The student showed a tendency to avoid difficult problems or avoid asking for help.",
        "productive_struggle": "The student struggled with difficulty while using hints, but ultimately solved the problem through productive effort.",
        "unproductive_frustration": "The student experienced unproductive frustration amid repeated failures or difficulty.",
        "lucky_guess": "The student answered correctly by chance, without properly understanding the problem.",
        "slipping": "The student made an unexpected mistake on content they had previously understood well.",
        "boredom_offtask": "The student showed signs of boredom and off-task behavior.",
    },
}

# Notes of the facts.
TRIAD_INACTIVE = {
    "ko": "낮은 확신/추측/생산적 분투 관련 신호 모두 미약함",
    "en": "All signals related to low confidence, guessing, and productive struggle are weak.",
}
TRIAD_DIRECTION = {
    "ko": {
        "guess": "(참고: 확신도가 낮아 추측 쪽에 약간 더 가까운 신호)",
        "struggle": "(참고: 확신도가 높아 생산적 분투 쪽에 약간 더 가까운 신호)",
        "mid": "(확신도도 중간값이라 방향성조차 약함)",
    },
    "en": {
        "guess": "(Note: confidence is low, so the signal leans slightly toward guessing.)",
        "struggle": "(Note: confidence is high, so the signal leans slightly toward productive struggle.)",
        "mid": "(Confidence is also mid-range, so even the direction of the signal is weak.)",
    },
}
TRIAD_AMBIGUOUS = {
    "ko": "힌트 미사용 상태에서 정답을 맞혔으나, 이것이 낮은 확신 속의 정답(underconfidence), 생산적 분투 끝의 정답(productive_struggle), 우연한 정답(lucky_guess) 중 무엇인지는 현재 데이터로 구조적으로 구분 불가능함. {direction}",
    "en": "The student answered correctly without using a hint, but the current data cannot structurally distinguish whether this reflects a correct answer despite low confidence (underconfidence), a correct answer after productive struggle (productive_struggle), or a lucky guess (lucky_guess). {direction}",
}
TRIAD_DOMINANT = {
    "ko": "{dominant} 우세 (힌트 사용 구간이라 독립 판정 가능)",
    "en": "{dominant} is dominant (independent judgment is possible since a hint was used).",
}
WEAK_NOTE = {
    "ko": "약한 신호, 서술 시 단정 표현 지양 권장",
    "en": "Weak signal — avoid definitive phrasing when describing this.",
}
OVERLAP_NOTE = {
    "ko": " [지시: overconfidence와 slipping이 함께 나타났지만, 이 둘의 관계나 상관성에 대해 언급하는 문장은 절대 추가하지 마세요 — 마치 둘 중 하나만 있는 것처럼, 각각을 있는 그대로 독립적으로만 서술하세요.]",
    "en": " [Instruction: overconfidence and slipping are both present here, but do not add any sentence commenting on the relationship or correlation between them — just describe each one plainly and independently, exactly as you would if only that one indicator applied.]",
}
RAW_NOTE = {
    "ko": "기호화(임계값 판정) 없이 원 지표 수치를 그대로 제시함 — Stage 1 제거 조건.",
    "en": "Shown as the raw indicator value with no symbolic thresholding applied — Stage 1 ablated.",
}

# Premise sentences.
PREMISE_RAW = {
    "ko": "이 지표({i})의 원값은 {v}이다 (0~1 범위, 임계값 판정 없음).",
    "en": "The raw value of this indicator ({i}) is {v} (range 0-1, no thresholding applied).",
}
PREMISE_STATUS = {
    "ko": "이 지표({i})의 상태는 {s}이다.",
    "en": "The status of this indicator ({i}) is {s}.",
}

# Lines of the evidence block.
BLOCK = {
    "ko": {
        "skill": "- 스킬: ", "step": "- 시점(step): ", "context": "[상황 정보]", "evidence": "[근거 목록]",
        "ambiguous": "- [{i}] 상태=판단불가(AMBIGUOUS). {n}", "high": "- [{i}] 상태=HIGH{v}. {n}",
        "raw": "- [{i}] 원값={v} (0~1 범위, 임계값 판정 없음). {n}", "value": " (값={v})",
        "none": "- (특별히 강한 신호 없음. 이 경우 '뚜렷한 특이 패턴이 관찰되지 않았다' 정도로만 서술하고, 이 문장 뒤에는 대괄호 인용 태그를 붙이지 마세요 — 인용할 구체적인 근거 항목이 없기 때문입니다. 이것은 규칙 2의 유일한 예외입니다.)",
    },
    "en": {
        "skill": "- Skill: ", "step": "- Step: ", "context": "[Context]", "evidence": "[Evidence List]",
        "ambiguous": "- [{i}] status=Cannot Determine (AMBIGUOUS). {n}", "high": "- [{i}] status=HIGH{v}. {n}",
        "raw": "- [{i}] raw value={v} (range 0-1, no thresholding applied). {n}", "value": " (value={v})",
        "none": "- (No particularly strong signal observed. In this case, write only something like 'no clear unusual pattern was observed' — and do NOT add a bracketed citation tag after this sentence, since there is no specific evidence item to cite. This is the one exception to Rule 2.)",
    },
}

# Patterns that mark a sentence, by language.
LEAKED = {
    "ko": [
        r"HIGH|LOW|AMBIGUOUS", r"\(\s*값\s*=", r"판단불가\s*\(\s*AMBIGUOUS\s*\)", r"\[\s*지시\s*[:：]", r"규칙\s*\d", r"근거\s*목록",
        r"내부\s*상태\s*표기", r"지표\s*변수명", r"대괄호로?\s*(표시|인용)", r"헤지\s*\(\s*hedge\s*\)", r"교육이론\s*용어", r"Yerkes-Dodson|Flow Theory",
    ],
    "en": [
        r"\bHIGH\b|\bLOW\b|\bAMBIGUOUS\b", r"\(\s*value\s*=", r"Cannot Determine\s*\(\s*AMBIGUOUS\s*\)", r"\[\s*Instruction\s*[:：]", r"\bRule\s*\d", r"Evidence\s*List",
        r"internal\s*state\s*label", r"indicator\s*variable\s*name", r"bracket(ed)?\s*(citation\s*)?tag", r"hedg(e|ing)\s*(language|phrasing)?", r"educational[- ]theory\s*term", r"Yerkes-Dodson|Flow Theory",
    ],
}
CODE = r"```|^\s*import\s+\w|\bdef\s+\w+\s*\("
FOREIGN = r"[぀-ゟ゠-ヿ一-鿿]"
LATIN = r"[A-Za-zÀ-ɏ]{2,}"
HANGUL = r"[가-힣]"
TYPO = r"힐프|힐티|힐난|힐끔|힐링"
TYPO_FIX = "힌트"
RECOMMENDATION = {
    "ko": r"(필요합니다|필요하다|필요해\s|권장|지도가|지도를|도와줄\s*수\s*있을|관리하여|관리해야|개입하여|개입해야|가이드|피드백을\s*주|격려|지원해야|지원이\s*필요|제공하여|제공하는\s*것이|확인하는\s*것이\s*필요|확보하는\s*것이\s*필요)",
    "en": r"(?i)\b(should|needs? to|must|it (is|would be) (necessary|advisable|recommended|beneficial)|is recommended|requires? (more|additional|further)|consider (providing|offering|giving)|would benefit from|needs? (support|guidance|intervention|encouragement|feedback)|provide (more|additional)|ought to)\b",
}
VARIABLE_NAME = r"\(\s*(overconfidence|underconfidence|strategic_help|cognitive_avoidance|productive_struggle|unproductive_frustration|lucky_guess|slipping|boredom_offtask)\s*\)"
ECHOED = {"ko": r"^\s*-\s*\[[^\]]+\]\s*상태\s*=", "en": r"^\s*-\s*\[[^\]]+\]\s*status\s*="}
DEFINITIVE = {
    "ko": [r"것이다\.?$", r"였다\.?$", r"했다\.?$", r"확실히", r"분명히", r"명백히", r"틀림없이", r"임이? 분명", r"것이 확실"],
    "en": [r"\bdefinitely\b", r"\bcertainly\b", r"\bclearly\b", r"\bobviously\b", r"\bundoubtedly\b", r"\bwithout (a )?doubt\b", r"\bsurely\b", r"\bwas (a|an)\b", r"\bwas the case\b"],
}
HEDGE = {
    "ko": [r"수 있(다|습니다)", r"로 보(인다|입니다)", r"가능성이 있", r"것으로 (추정|보임|판단)", r"인 듯", r"수도 있", r"단정하기 어렵", r"확실하지 않"],
    "en": [r"\bmay (have )?\b", r"\bmight (have )?\b", r"\bcould (have )?\b", r"\bpossibly\b", r"\bperhaps\b", r"\bappears? to\b", r"\bseems? to\b", r"\bis (unclear|uncertain)\b", r"\bdifficult to (say|determine)\b", r"\bnot certain\b", r"\blikely\b"],
}

# Tag spellings and what they mean.
TAGS = ["supported", "partial", "unsupported", "unknown"]
TYPOS = {"unsuppported": "unsupported", "unsuported": "unsupported", "suported": "supported"}
STATUS_WORDS = ["nan", "none", "indicator", "indicators", "high", "ambiguous", "low", "weak"]
TAG_NAMES = {
    "지지됨": "supported", "부분지지": "partial", "근거없음": "unsupported", "판단불가": "unknown",
    "supported": "supported", "partial": "partial", "unsupported": "unsupported", "unknown": "unknown",
}
TRUE_VALUES = ["1", "true", "yes", "y", "t", "o", "counter", "contradicted", "1.0"]

# Words of affect, and names of indicators as they appear in sentences.
AFFECT = r"frustrat|confus|bored|concentrat|emotion|feel|interest"
INDICATOR_WORDS = r"overconfiden|underconfiden|slipping|lucky[ _]guess|confidence[ _]triad|cognitive[ _]avoidance|productive[ _]struggle|unproductive[ _]frustration|strategic[ _]help|boredom[ _]offtask"

# Sentences of the template narrative.
TEMPLATE_NONE = {"ko": "특별히 강한 신호가 관찰되지 않았다.", "en": "No particularly strong signal was observed."}
TEMPLATE_AMBIGUOUS = {"ko": "판단이 불가능한 신호가 관찰되었다.", "en": "An indeterminate signal was observed."}
TEMPLATE_OTHER = {"ko": "{i} 신호가 강하게 관찰되었다.", "en": "A strong {i} signal was observed."}
