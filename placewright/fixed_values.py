"""Word lists, lookup tables, constants, patterns and formats.

Results are only right when these values equal the published data contract, so
they are stated here plainly, once, as text. Logic lives elsewhere.
"""

from __future__ import annotations

# --- fixed values: administrative areas, in canonical order -----------------
AREAS = [
    "종로구", "중구", "용산구", "성동구", "광진구", "동대문구", "중랑구", "성북구", "강북구",
    "도봉구", "노원구", "은평구", "서대문구", "마포구", "양천구", "강서구", "구로구", "금천구",
    "영등포구", "동작구", "관악구", "서초구", "강남구", "송파구", "강동구",
]
AREA_SUFFIX = "구"
CITY_PREFIXES = ["서울특별시", "서울시", "서울"]
NULL_WORDS = ["nan", "none", "null"]
AREA_WORD_PATTERN = "([가-힣]+구)"

# --- fixed values: landmark -> area, one table per use ----------------------
GOLD_LANDMARK_AREAS = {
    "서울시청": "중구", "시청": "중구", "광화문": "종로구", "왕십리": "성동구", "성수": "성동구",
    "여의도": "영등포구", "신촌": "서대문구", "홍대": "마포구", "잠실": "송파구", "목동": "양천구",
    "고덕": "강동구", "마곡": "강서구", "청량리": "동대문구", "사당": "동작구", "신림": "관악구",
    "강남역": "강남구", "서울역": "중구",
}
ALIAS_LANDMARK_AREAS = {
    "광화문": "종로구", "광화문광장": "종로구", "서울시청": "중구", "시청": "중구", "여의도": "영등포구",
    "성수": "성동구", "성수동": "성동구", "강남": "강남구", "잠실": "송파구", "고덕": "강동구",
    "마곡": "강서구", "정릉": "성북구",
}
RANK_LANDMARK_AREAS = {"광화문": "종로구", "세종대로": "중구"}
START_LANDMARK_AREAS = {
    "서울시청": "중구", "시청역": "중구", "광화문": "종로구", "왕십리역": "성동구", "왕십리": "성동구",
    "성동구청": "성동구", "성수역": "성동구", "성수": "성동구", "강남역": "강남구", "강남": "강남구",
    "홍대입구": "마포구", "홍대": "마포구", "여의도": "영등포구", "구로디지털단지": "구로구",
    "신림역": "관악구", "신림": "관악구", "건대입구": "광진구", "잠실역": "송파구", "잠실": "송파구",
}
STATION_AREAS = {
    "강남": "강남구", "건대입구": "광진구", "가산디지털단지": "금천구", "까치산": "강서구",
    "고속터미널": "서초구", "구로디지털단지": "구로구", "구의": "광진구", "구의(광진구청)": "광진구",
    "낙성대": "관악구", "낙성대(강감찬)": "관악구", "노원": "노원구", "당산": "영등포구",
    "명동": "중구", "봉천": "관악구", "사당": "동작구", "삼성": "강남구", "삼성(무역센터)": "강남구",
    "서울역": "중구", "서울대입구": "관악구", "서울대입구(관악구청)": "관악구", "성수": "성동구",
    "선릉": "강남구", "수유": "강북구", "수유(강북구청)": "강북구", "신대방": "동작구",
    "신도림": "구로구", "신림": "관악구", "쌍문": "도봉구", "여의도": "영등포구", "역삼": "강남구",
    "연신내": "은평구", "영등포": "영등포구", "용산": "용산구", "을지로입구": "중구", "잠실": "송파구",
    "잠실(송파구청)": "송파구", "종각": "종로구", "청량리": "동대문구", "합정": "마포구",
    "홍대입구": "마포구", "화곡": "강서구", "혜화": "종로구",
}
ROUTE_ADJACENCY = {
    "성동구": ["중구", "광진구", "동대문구", "용산구"],
    "중구": ["종로구", "성동구", "용산구", "동대문구"],
    "마포구": ["서대문구", "용산구", "영등포구", "은평구"],
    "영등포구": ["마포구", "동작구", "양천구", "구로구"],
    "종로구": ["중구", "서대문구", "성북구", "동대문구"],
    "광진구": ["성동구", "중랑구", "동대문구", "송파구"],
    "송파구": ["강남구", "강동구", "광진구"],
    "강남구": ["서초구", "송파구", "성동구"],
    "서초구": ["강남구", "동작구", "관악구"],
}

# --- fixed values: name matching --------------------------------------------
KEY_DROP_PATTERN = "[^0-9a-z가-힣]"
RELAXED_TOKENS = ["전통", "재래", "공영", "공공"]
LOOSE_NAME_PATTERN = "(일대|앞|출구|광장|역|사거리)"
MATCH_PRIORITY = {"exact": 4, "alias": 3, "normalized": 2, "partial": 1}

# --- fixed values: place scorer ---------------------------------------------
SCORE_FEATURES = ["time_score", "age_score", "context_score", "facility_score", "interaction_score"]
TYPE_WEIGHTS = {
    "subway": [0.45, 0.17, 0.18, 0.05, 0.15],
    "park": [0.08, 0.14, 0.25, 0.38, 0.15],
    "senior_friendly": [0.08, 0.27, 0.18, 0.32, 0.15],
    "market": [0.12, 0.18, 0.18, 0.37, 0.15],
}
AUX_STRENGTH = 0.12
PARK_KEYWORDS = ["광장", "야외무대", "문화", "체육", "산책로"]
SENIOR_KEYWORD_WEIGHTS = {"노인복지관": 0.45, "종합복지관": 0.35, "노인교실": 0.30, "복지센터": 0.25}
AUX_FEATURES = [
    "commercial_age_20_40_ratio", "commercial_age_60_plus_ratio", "commercial_morning_flow_score",
    "commercial_afternoon_flow_score", "worker_age_20_40_ratio", "worker_age_60_plus_ratio",
    "living_pop_20_40_ratio", "living_pop_60_plus_ratio", "living_pop_morning_score",
    "living_pop_afternoon_score",
]
TRANSIT_BANDS = [
    "06_07", "07_08", "08_09", "09_10", "12_13", "13_14", "14_15", "15_16", "16_17", "17_18",
]
MESSAGE_RULES = [
    ("subway", "20_40", 1, "청년 일자리",
     "working-age commuters are likely to respond to jobs and economic opportunity messages"),
    ("subway", "20_40", 2, "출퇴근 교통 개선",
     "subway locations are strongly tied to daily commuting pain points"),
    ("subway", "20_40", 3, "주거비 부담 완화",
     "20_40 commuters often care about housing costs near work and transit"),
    ("park", "20_40", 1, "가족 친화 정책",
     "parks are effective places to connect with family-oriented daily life concerns"),
    ("park", "20_40", 2, "여가/문화 인프라 확대",
     "park visitors are likely to value leisure and cultural amenities in the neighborhood"),
    ("park", "20_40", 3, "생활체육·공원 개선",
     "the place context directly supports messages about exercise and park quality"),
    ("senior_friendly", "60_plus", 1, "어르신 복지 강화",
     "senior-friendly facilities align directly with welfare needs of older residents"),
    ("senior_friendly", "60_plus", 2, "의료 접근성 개선",
     "healthcare access is a core concern for many older adults"),
    ("senior_friendly", "60_plus", 3, "교통약자 이동 편의 확대",
     "mobility support is highly relevant in outreach for seniors and vulnerable riders"),
]
MESSAGE_DEFAULT = ("지역 맞춤 생활 정책", "used as a simple fallback when no specific rule is matched")
MARKET_MESSAGES = [
    ("market", "20_40", 1, "골목상권 활성화",
     "traditional markets are strong places to talk about local jobs and neighborhood commerce"),
    ("market", "20_40", 2, "생활밀착 물가 안정",
     "market visitors are closely connected to everyday household spending and price concerns"),
    ("market", "20_40", 3, "소상공인 지원 확대",
     "merchant-heavy spaces fit messages about small business support and local resilience"),
    ("market", "60_plus", 1, "전통시장 생활 편의 개선",
     "traditional markets are familiar daily destinations for many older residents"),
    ("market", "60_plus", 2, "보행·이동 환경 개선",
     "market outreach naturally connects to walkability and mobility issues in the neighborhood"),
    ("market", "60_plus", 3, "생활권 복지 접근성 강화",
     "market-centered outreach fits messages about nearby welfare and essential services"),
]

# --- fixed values: request context ------------------------------------------
SENIOR_WORDS = ["노년", "노인", "어르신", "고령", "복지", "60"]
REQUEST_TYPE_RULES = [
    ("market", ["전통시장", "시장", "골목상권", "상권", "상인"]),
    ("senior_friendly", ["복지", "노인", "어르신", "고령"]),
    ("subway", ["교통", "역", "퇴근", "출근", "사거리"]),
    ("park", ["공원", "하천", "도림천", "산", "광장", "체육", "어린이", "가족"]),
]
REQUEST_TYPE_DEFAULT = ["market", "park", "subway", "senior_friendly"]
EXPECTED_TYPE_RULES = [
    ("market", ["전통시장", "시장", "골목상권", "상권", "상인"]),
    ("park", ["공원", "광장", "하천", "도림천", "산", "체육", "어린이", "가족"]),
    ("senior_friendly", ["복지", "노인", "어르신", "고령", "노년"]),
    ("subway", ["교통", "역", "퇴근", "출근", "사거리", "직장인"]),
]

# --- fixed values: aliases ---------------------------------------------------
TYPE_COMPATIBILITY = {
    "전통시장": ["전통시장", "골목상권"],
    "골목상권": ["골목상권", "전통시장"],
    "공원": ["공원", "체육시설", "어린이/가족시설"],
    "체육시설": ["체육시설", "공원", "어린이/가족시설"],
    "어린이/가족시설": ["어린이/가족시설", "공원", "체육시설", "복지시설"],
    "복지시설": ["복지시설"],
    "교통거점": ["교통거점", "노동현장"],
    "정책현장": ["정책현장"],
    "노동현장": ["노동현장", "교통거점", "공원"],
    "재개발/도시개발현장": ["재개발/도시개발현장", "정책현장"],
    "종교시설": ["종교시설"],
}
ALIAS_TYPE_RULES = [
    ("market", ["시장", "상가", "상권", "터미널", "맛의거리", "카페거리", "정동길", "약국"]),
    ("subway", ["역", "출구", "사거리", "차고지", "차량사업소", "비즈밸리", "교통"]),
    ("park", ["공원", "천", "수변", "팔각정", "벚꽃길", "산", "운동장", "체육관", "경기장", "스포츠"]),
    ("senior_friendly", ["복지", "노인", "홈리스", "나눔", "센터", "어버이날"]),
]
ALIAS_TYPE_BY_LABEL = {
    "전통시장": "market", "골목상권": "market", "정책현장": "market",
    "공원": "park", "체육시설": "park", "어린이/가족시설": "park", "종교시설": "park",
    "복지시설": "senior_friendly",
    "교통거점": "subway", "노동현장": "subway", "재개발/도시개발현장": "subway",
}
ALIAS_STATION_WORDS = ["출구", "역", "사거리"]
ALIAS_LANDMARK_WORDS = ["광장", "팔각정", "공원", "수변", "폭포", "동산", "차고지", "체육관", "운동장"]
ALIAS_CLASS_PREFERENCE = [
    "gold_specific_alias 의심", "public_poi_alias", "station_exit_alias", "district_landmark_alias",
    "common_name_alias", "manual_seed",
]

# --- fixed values: small additive bonuses ------------------------------------
MODEL_VARIANTS = ["baseline", "area_weighted", "type_weighted", "time_weighted", "combined"]
VARIANT_TIME_BONUS = [
    (7, 10, {"subway": 0.14, "market": 0.05, "senior_friendly": 0.05}),
    (10, 12, {"senior_friendly": 0.10, "market": 0.10, "park": 0.06}),
    (12, 16, {"market": 0.12, "park": 0.12, "senior_friendly": 0.06}),
    (16, 20, {"market": 0.12, "subway": 0.12, "park": 0.06}),
]
VARIANT_CONTEXT_BONUS = [
    ("market", 0.07, ["상인", "지역상권", "생활권", "상권"]),
    ("park", 0.06, ["가족", "일반시민", "체육", "방문인사"]),
    ("senior_friendly", 0.07, ["노년", "노인", "복지", "어르신"]),
    ("subway", 0.06, ["직장인", "퇴근", "출근", "교통"]),
]
VARIANT_TARGET_BONUS = [
    ("senior_friendly", 0.08, ["노년", "노인", "어르신", "복지"]),
    ("market", 0.06, ["상인", "지역주민", "생활권"]),
    ("subway", 0.05, ["직장인", "퇴근길", "일반시민"]),
    ("park", 0.05, ["가족", "일반시민", "지역주민"]),
]

# --- fixed values: tuned 0-1 features ----------------------------------------
TUNED_CATEGORY_WORDS = {
    "market": ["전통시장", "시장", "골목상권", "상권", "상점가", "로데오", "먹자", "맛의거리",
               "음식문화거리", "상인", "생활밀착"],
    "park": ["공원", "광장", "하천", "도림천", "응봉산", "둘레길", "체육", "운동장", "어린이", "가족", "야외"],
    "senior_friendly": ["복지", "노인", "어르신", "노년", "고령", "종합사회복지관", "복지관", "장애인"],
    "subway": ["교통", "역", "지하철", "사거리", "퇴근", "출근", "직장인", "환승", "거점"],
    "labor_site": ["노동", "노조", "근로", "산업", "현장"],
    "urban_site": ["재개발", "도시개발", "주거", "정비", "정책현장"],
    "religious": ["종교", "교회", "성당", "사찰", "법회"],
    "youth": ["대학", "청년", "캠퍼스", "청년공간"],
}
TUNED_RELATEDNESS = [
    ("labor_site", "market", 0.35), ("urban_site", "market", 0.25), ("urban_site", "subway", 0.20),
    ("religious", "park", 0.15), ("youth", "subway", 0.30), ("youth", "market", 0.20),
    ("park", "senior_friendly", 0.20), ("senior_friendly", "park", 0.20),
    ("market", "subway", 0.15), ("subway", "market", 0.15),
]
TUNED_TIME_TABLE = [
    (7, 10, {"subway": 1.0, "market": 0.35, "senior_friendly": 0.20, "park": 0.15}),
    (10, 12, {"senior_friendly": 0.80, "market": 0.70, "park": 0.40, "subway": 0.30}),
    (12, 14, {"market": 0.85, "park": 0.65, "senior_friendly": 0.45, "subway": 0.20}),
    (14, 17, {"market": 0.80, "park": 0.70, "senior_friendly": 0.55, "subway": 0.25}),
    (17, 20, {"subway": 1.0, "market": 0.80, "park": 0.40, "senior_friendly": 0.25}),
]
TUNED_TIME_OTHER = {"market": 0.50, "subway": 0.40, "park": 0.25, "senior_friendly": 0.20}
TUNED_TARGET = [
    ("senior_friendly", 1.0, ["노년", "노인", "어르신", "복지", "장애인"]),
    ("market", 0.75, ["상인", "지역주민", "생활권", "일반시민"]),
    ("subway", 0.70, ["직장인", "퇴근길", "출근", "일반시민", "청년"]),
    ("park", 0.70, ["가족", "어린이", "체육", "일반시민", "지역주민"]),
]
TUNED_STOP_TAGS = ["오전", "오후", "저녁", "아침", "점심", "출근", "퇴근"]
TUNED_WEIGHTS = [
    "baseline_weight", "area_weight", "type_weight", "time_weight", "context_weight", "target_weight",
    "rank_weight",
]
TUNED_GRID = [
    [1.0], [0.2, 0.3, 0.4, 0.5, 0.7], [0.0, 0.1, 0.2, 0.3], [0.0, 0.05, 0.1, 0.2],
    [0.0, 0.05, 0.1, 0.2], [0.0, 0.05, 0.1, 0.2], [0.0, 0.05, 0.1],
]
TUNED_REQUIRED = [
    [1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0],
    [1.0, 0.2, 0.0, 0.0, 0.0, 0.0, 0.0],
    [1.0, 0.3, 0.1, 0.05, 0.05, 0.05, 0.05],
]
OBJECTIVE = {"ndcg_10": 0.35, "p_1": 0.25, "p_3": 0.20, "p_5": 0.10, "r_10": 0.10}

# --- fixed values: final ranking features ------------------------------------
FINAL_CATEGORY_WORDS = {
    "market": ["전통시장", "시장", "상권", "상가", "상인", "골목", "거리", "로데오", "먹자", "생활권", "지역상권"],
    "park": ["공원", "광장", "하천", "체육", "어린이", "가족", "산책", "문화", "생활밀착"],
    "senior_friendly": ["복지", "노인", "어르신", "경로", "고령", "복지관", "경로당"],
    "subway": ["교통", "지하철", "역", "출근", "퇴근", "사거리", "환승", "직장인"],
    "labor_site": ["노동", "노조", "근로", "산업", "현장", "사업장"],
    "urban_site": ["재개발", "정비", "주거", "아파트", "정책현장", "도시"],
    "youth": ["청년", "대학", "캠퍼스", "청년공간"],
    "religious": ["교회", "성당", "사찰", "법회", "종교"],
    "policy": ["공약", "정책", "발표", "간담회", "현장방문"],
}
FINAL_RELATEDNESS = [
    ("market", "subway", 0.35), ("subway", "market", 0.35), ("market", "park", 0.20),
    ("park", "market", 0.20), ("park", "senior_friendly", 0.30), ("senior_friendly", "park", 0.30),
    ("labor_site", "market", 0.45), ("labor_site", "subway", 0.35), ("urban_site", "market", 0.35),
    ("urban_site", "subway", 0.30), ("youth", "subway", 0.45), ("youth", "market", 0.30),
    ("religious", "park", 0.20), ("policy", "senior_friendly", 0.30), ("policy", "park", 0.20),
]
FINAL_TIME_TABLE = {
    "morning_commute": {"subway": 1.0, "market": 0.40, "park": 0.20, "senior_friendly": 0.20},
    "late_morning": {"senior_friendly": 0.80, "market": 0.70, "park": 0.45, "subway": 0.30},
    "lunch": {"market": 0.85, "park": 0.60, "senior_friendly": 0.45, "subway": 0.20},
    "afternoon": {"market": 0.80, "park": 0.75, "senior_friendly": 0.60, "subway": 0.25},
    "evening_commute": {"subway": 1.0, "market": 0.85, "park": 0.45, "senior_friendly": 0.25},
    "evening": {"market": 0.70, "subway": 0.55, "park": 0.35, "senior_friendly": 0.20},
}
TIME_BUCKETS = [
    (6, 10, "morning_commute"), (10, 12, "late_morning"), (12, 14, "lunch"), (14, 17, "afternoon"),
    (17, 20, "evening_commute"),
]
FINAL_TARGET = [
    ("senior_friendly", 1.0, ["노인", "어르신", "복지", "고령", "시니어"]),
    ("market", 0.90, ["상인", "지역주민", "생활권", "상권", "일반시민"]),
    ("subway", 0.85, ["직장인", "출근", "퇴근", "청년", "일반시민"]),
    ("park", 0.80, ["가족", "지역주민", "체육", "일반시민", "생활권"]),
]
FOOTFALL_TYPE = {"market": 0.95, "subway": 0.95, "park": 0.65, "senior_friendly": 0.45}
FOOTFALL_TYPE_OTHER = 0.35
FOOTFALL_SLOT = {"morning_commute": 0.90, "lunch": 0.80, "afternoon": 0.70, "evening_commute": 0.95}
FOOTFALL_SLOT_OTHER = 0.55
WORKER_WORDS = ["직장인", "출근", "퇴근", "청년"]
TRANSIT_NAME_WORDS = ["역", "출구", "사거리", "버스", "환승"]
MARKET_NAME_WORDS = ["시장", "상가", "거리", "상권", "로데오"]
WELFARE_WORDS = ["복지", "정책", "공약", "어르신", "노인", "정책현장"]
WELFARE_PARK_WORDS = ["생활밀착", "가족", "체육"]
FINAL_FEATURES = [
    "area_match", "type_match", "time_match", "target_match", "footfall", "worker", "transit", "market",
    "welfare", "context_match", "style", "diversity", "rank_score", "semantic", "composite",
]
FINAL_WEIGHTS = [
    "baseline_weight", "area_weight", "type_weight", "time_weight", "context_weight", "target_weight",
    "population_weight", "transit_weight", "commercial_weight", "welfare_weight", "profile_weight",
    "diversity_weight",
]
FINAL_GRID = [
    [1.0], [0.20, 0.35, 0.50, 0.65], [0.10, 0.25, 0.40], [0.05, 0.15, 0.25], [0.10, 0.20, 0.35],
    [0.05, 0.15, 0.25], [0.00, 0.10, 0.20], [0.00, 0.08, 0.16], [0.00, 0.08, 0.16], [0.00, 0.08, 0.16],
    [0.00, 0.10, 0.20], [0.00, 0.05, 0.10],
]
FINAL_MODEL_WEIGHTS = {
    "baseline": [1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0],
    "context": [1.0, 0.35, 0.25, 0.15, 0.20, 0.10, 0.10, 0.08, 0.08, 0.08, 0.0, 0.0],
    "profile": [1.0, 0.35, 0.25, 0.15, 0.20, 0.10, 0.10, 0.08, 0.08, 0.08, 0.18, 0.0],
}
FINAL_EXTRA_TRIAL = [1.0, 0.50, 0.40, 0.15, 0.35, 0.10, 0.10, 0.08, 0.08, 0.08, 0.20, 0.05]
FINAL_RANK_WEIGHT = 0.03
COMPOSITE = {
    "area_match": 0.25, "type_match": 0.25, "time_match": 0.15, "context_match": 0.15,
    "target_match": 0.10, "semantic": 0.10,
}
FINAL_OBJECTIVE = {
    "ndcg_10": 0.35, "r_10": 0.20, "composite_10": 0.20, "area_10": 0.10, "type_10": 0.10, "time_10": 0.05,
}
PRIOR_DISCOUNT = 0.35

# --- fixed values: gold normalisation -----------------------------------------
UNKNOWN_WORDS = ["", "nan", "none", "null", "해당 없음", "확인 필요", "unknown", "미상"]
TRUE_WORDS = ["true", "t", "1", "yes", "y", "사용", "예", "네", "맞음"]
REFERENCE_DAY = "2026-06-03"
WEEKDAYS = ["월", "화", "수", "목", "금", "토", "일"]
PLACE_TYPE_RULES = [
    ("전통시장", ["시장", "전통시장", "상인회"]),
    ("골목상권", ["상권", "상점가", "먹자골목", "로데오", "거리"]),
    ("교통거점", ["역", "출구", "사거리", "버스", "환승", "출근", "퇴근", "지하철"]),
    ("공원", ["공원", "광장", "하천", "둘레길", "산책로"]),
    ("체육시설", ["체육", "운동장", "구장", "경기장", "스포츠"]),
    ("복지시설", ["복지", "노인", "어르신", "장애인", "종합사회복지관", "복지관"]),
    ("정책현장", ["공약", "정책", "발표", "민원", "현장"]),
    ("노동현장", ["노동", "노조", "근로", "산업", "일터"]),
    ("재개발/도시개발현장", ["재개발", "재건축", "도시개발", "정비사업", "주거"]),
    ("종교시설", ["교회", "성당", "사찰", "법회", "종교"]),
    ("직능단체", ["협회", "단체", "연합회", "간담회", "협약"]),
    ("방송/언론", ["방송", "라디오", "TV", "유튜브", "인터뷰", "토론", "기자회견"]),
    ("캠프/정당", ["캠프", "당사", "선대위", "회의"]),
]
PLACE_TYPE_DEFAULT = "기타/확인필요"
ACTIVITY_RULES = [
    ("거리인사", ["출근", "퇴근", "인사"]),
    ("지역상권방문", ["시장", "상권", "상점가"]),
    ("주민간담회", ["간담회", "대화", "타운홀"]),
    ("정책협약", ["협약", "협약식"]),
    ("공약발표", ["발표", "공약", "기자회견"]),
    ("방송출연", ["방송", "인터뷰", "라디오", "유튜브", "토론"]),
    ("종교행사", ["예배", "미사", "법회", "종교"]),
    ("현장방문", ["현장", "방문"]),
    ("내부/정당행사", ["회의", "선대위", "캠프"]),
]
ACTIVITY_DEFAULT = "확인필요"
TARGET_RULES = [
    ("상인", ["상인", "시장", "상권", "소상공인"]),
    ("어르신", ["노인", "어르신", "복지", "60"]),
    ("청년", ["청년", "대학", "캠퍼스"]),
    ("노동자", ["노동", "근로", "노조"]),
    ("직장인", ["출근", "퇴근", "역", "교통"]),
    ("지역주민", ["주민", "아파트", "재개발", "주거"]),
]
TARGET_DEFAULT = "일반시민"
PRESENCE_RULES_LOWER = [
    ("hybrid", ["hybrid"]), ("offline", ["offline", "in-person"]), ("online", ["online", "youtube", "zoom"]),
]
PRESENCE_RULES = [
    ("online", ["온라인", "유튜브", "방송", "라디오", "인터뷰"]),
    ("hybrid", ["혼합", "하이브리드", "hybrid"]),
    ("offline", ["오프라인", "방문", "시장", "역", "공원", "현장", "간담회", "행사"]),
]
LABEL_ONLINE_WORDS = ["방송", "인터뷰", "유튜브", "토론"]
LABEL_INTERNAL_WORDS = ["내부", "회의", "비공개", "이동"]
LABEL_MEDIA_WORDS = ["방송", "유튜브", "전화", "인터뷰"]
LABEL_SECONDARY_WORDS = ["협약", "토론", "기자회견", "당사", "캠프", "종교", "예배", "미사"]
LABEL_STRONG_WORDS = [
    "시장", "역", "출근", "퇴근", "거리", "상권", "공원", "복지", "체육", "현장", "재개발", "간담회", "방문", "노동",
]
LABEL_REASONS = {
    3: "오프라인 방문이며 장소명과 지역 맥락이 있어 장소 추천 정답으로 적합함",
    2: "장소 의미는 있으나 직접 유세 장소성은 보조적인 일정임",
    1: "장소 추천보다 메시지 또는 미디어 노출 평가에 가까운 일정임",
    0: "장소 정보가 부족하거나 온라인/내부 일정으로 장소 추천 평가에서 제외함",
}
DAYPART_TAGS = {"morning": "오전", "afternoon": "오후", "evening": "저녁"}
SCHEDULE_TIME_PATTERN = r"(오전|오후|AM|PM|am|pm)?\s*(\d{1,2})(?:[:：시]\s*(\d{1,2}))?"

# --- fixed values: routes -----------------------------------------------------
ROUTE_TYPE_LABELS = {
    "market": "전통시장", "subway": "교통거점", "station": "교통거점", "park": "공원",
    "senior_friendly": "복지시설", "senior": "복지시설", "welfare": "복지시설", "commercial": "골목상권",
    "public": "정책현장", "policy_site": "정책현장",
}
ROUTE_TYPE_OTHER = "기타"
ADDRESS_PLACEHOLDERS = ["", "확인 필요", "해당 없음", "nan", "None"]
ADDRESS_UNKNOWN = "주소 확인 필요"
STAGE_BONUS = {
    "strict_real_candidates": 0.16, "relaxed_place_type_real_candidates": 0.08,
    "relaxed_context_real_candidates": 0.04, "all_real_district_candidates": 0.0,
    "district_fallback_seed": -0.04, "synthetic_district_fallback": -0.08,
}
SOURCE_ALIASES = {
    "public_market": "market_csv", "market": "market_csv", "public_park": "park_csv", "park": "park_csv",
    "public_subway": "subway_csv", "subway": "subway_csv", "public_welfare": "welfare_csv",
    "senior_csv": "welfare_csv", "senior_welfare": "welfare_csv",
    "public_commercial": "commercial_street_csv", "commercial_csv": "commercial_street_csv",
}
SOURCE_DEFAULT = "route_candidate_pool"
SOURCE_PRIORITY = {
    "backend_api": 1, "route_candidate_pool": 1, "market_csv": 2, "park_csv": 2, "subway_csv": 2,
    "welfare_csv": 2, "medical_welfare_csv": 2, "commercial_worker_csv": 2, "commercial_street_csv": 2,
    "public_csv": 2, "frontend_static_json": 3, "relaxed_real_candidate": 4, "address_based_candidate": 5,
    "district_fallback_seed": 90, "synthetic_district_fallback": 100,
}
SOURCE_PRIORITY_OTHER = 50
FALLBACK_SOURCES = ["district_fallback_seed", "synthetic_district_fallback"]
POOL_SCORES = {
    "subway_csv": (0.92, 0.35), "market_csv": (0.90, 0.30), "park_csv": (0.86, 0.28),
    "welfare_csv": (0.88, 0.0), "medical_welfare_csv": (0.86, 0.0),
    "commercial_worker_csv": (0.88, 0.32), "commercial_street_csv": (0.88, 0.32),
}
ROUTE_TIME_FIT = [
    (7, 10, {"교통거점": 0.30, "골목상권": 0.16, "전통시장": 0.14}),
    (10, 12, {"전통시장": 0.24, "복지시설": 0.22, "정책현장": 0.20, "교통거점": 0.12}),
    (12, 14, {"골목상권": 0.26, "전통시장": 0.24, "교통거점": 0.14}),
    (14, 17, {"공원": 0.22, "복지시설": 0.20, "체육시설": 0.20, "정책현장": 0.20}),
    (17, 20, {"교통거점": 0.30, "골목상권": 0.22, "전통시장": 0.20}),
]
ROUTE_TIME_FIT_OTHER = {"교통거점": 0.10, "전통시장": 0.10, "골목상권": 0.10}
ROUTE_TARGET_TYPES = [
    ("직장인", ["교통거점", "골목상권", "전통시장"]),
    ("청년", ["교통거점", "골목상권", "공원"]),
    ("상인", ["전통시장", "골목상권"]),
    ("노년층", ["복지시설", "전통시장", "공원"]),
    ("가족/어린이", ["공원", "체육시설", "복지시설"]),
    ("지역주민", ["전통시장", "골목상권", "공원", "복지시설"]),
]
SYNTHETIC_TYPES = ["교통거점", "골목상권", "전통시장", "공원", "정책현장"]
TYPE_EXPLANATIONS = {
    "교통거점": "주민 이동이 많은 생활 거점으로 현장 인사를 진행하기 좋습니다.",
    "전통시장": "지역 상권과 생활 동선을 함께 확인하기 좋은 장소입니다.",
    "골목상권": "지역 상권과 생활 동선을 함께 확인하기 좋은 장소입니다.",
    "복지시설": "생활 유권자와 접촉하기 좋은 현장입니다.",
    "공원": "지역 현안을 듣고 후보 메시지를 전달하기 좋은 장소입니다.",
    "정책현장": "지역 현안을 듣고 후보 메시지를 전달하기 좋은 장소입니다.",
}
TYPE_EXPLANATION_OTHER = "생활 유권자와 접촉하기 좋은 현장입니다."
NAME_OVERRIDES = {
    "강남": "강남역 11번 출구 앞", "강남역": "강남역 11번 출구 앞", "성수": "성수역 3번 출구 앞",
    "성수역": "성수역 3번 출구 앞", "왕십리": "왕십리역 광장", "왕십리역": "왕십리역 광장",
    "서울시청": "서울시청 앞 광장", "시청": "서울시청 앞 광장", "시청역": "시청역 5번 출구 앞",
    "홍대": "홍대입구역 9번 출구 앞", "홍대입구": "홍대입구역 9번 출구 앞", "여의도": "여의도역 5번 출구 앞",
    "건대입구": "건대입구역 2번 출구 앞", "신림": "신림역 4번 출구 앞", "잠실": "잠실역 8번 출구 앞",
    "종로": "종로3가역 일대",
}
SQUARE_STATIONS = ["왕십리역", "서울역", "청량리역"]
ROUTE_DEFAULTS = {
    "date": "2026-05-20", "start_time": "09:00", "end_time": "18:00", "start_location": "서울시청",
    "target_group": "직장인", "goal": "퇴근인사",
}
ROUTE_TEMPLATES = {
    "default": [
        ("07:00", "morning", "subway"), ("11:00", "afternoon", "park"),
        ("14:00", "afternoon", "senior_friendly"), ("18:00", "afternoon", "subway"),
    ],
    "neighborhood_focus": [
        ("10:00", "morning", "market"), ("13:00", "afternoon", "park"),
        ("15:00", "afternoon", "senior_friendly"), ("18:00", "afternoon", "subway"),
    ],
}
TARGET_COVERAGE = {
    "20_40": {"subway": 0.02, "park": 0.01, "market": 0.015},
    "60_plus": {"senior_friendly": 0.02, "market": 0.015, "park": 0.01},
}
KNOWN_STARTS = {
    "강남역": (37.4979, 127.0276), "성동구청": (37.5634, 127.0368), "왕십리역": (37.5613, 127.0371),
    "서울시청": (37.5663, 126.9779),
}
VALID_BOX = (37.0, 38.0, 126.0, 128.0)
EARTH_KM = 6371.0
MARKER_STATUSES = ["original", "merged_static", "cached", "geocoded", "known_seoul_coordinates"]
MARKER_SOURCES = [
    "original", "static", "kakao_address_search", "kakao_keyword_search", "known_seoul_coordinates",
]
FEATURE_LABEL_RULES = [
    ("역세권", "교통|station|subway|역|출구"),
    ("유동인구 높음", "교통|상권|시장|공원|station|subway|market|commercial|park"),
    ("직장인구 밀집", "직장|퇴근|출근|업무|오피스|office|worker"),
    ("상권 활성도 높음", "상권|시장|골목|market|commercial|street"),
    ("전통시장 존재", "전통시장|시장|market"),
    ("공원 존재", "공원|park|숲|광장"),
    ("복지시설 밀집", "복지|노인|senior|welfare"),
]
FEATURE_LABEL_OTHER = ["선택 자치구 적합", "생활권 접점"]
DISPLAY_SCORE_RULES = [
    ("market_score", "시장|상권|market|commercial", 0.88, 0.24),
    ("park_score", "공원|park|숲|광장", 0.86, 0.22),
    ("worker_score", "직장|출근|퇴근|교통|역|office|worker|subway|station", 0.80, 0.38),
    ("population_score", "유동|생활|교통|시장|상권|공원|역|flow|population", 0.82, 0.58),
]
FIT_LABELS = [(2.7, "적합도 높음"), (2.3, "적합도 보통")]
FIT_LABEL_OTHER = "보조 후보"
FIT_LABEL_NULL = "적합도 확인"

# --- fixed values: diagnosis texts --------------------------------------------
AREA_DIAGNOSIS = ("후보군 coverage 취약 자치구", "일부 장소 유형 보강 필요")
GROUP_DIAGNOSIS = (
    "candidate generation 병목이 큼", "후보는 있으나 reranking 또는 명칭 매칭 개선 여지",
    "후보군 coverage와 reranking이 상대적으로 양호",
)
HIT_REASONS = {
    "area": "자치구 일치 또는 생활권 인접 후보가 상위에 배치되어 hit",
    "type": "장소 유형 유사도가 상위 배치에 기여하여 hit",
    "base": "baseline_score와 보조 feature가 함께 작동하여 hit",
    "gap": "정답 장소가 raw 후보군에 없어 recall 한계",
    "low": "정답 장소가 raw 후보군에는 있었으나 bonus 부족으로 하위 랭크",
    "area_miss": "장소 유형은 유사했으나 자치구 불일치로 miss",
    "near": "정답 후보가 Top10 근처에 있었으나 점수 차이로 miss",
}
CONTRIBUTION_COMMENTS = (
    "hit 후보와 양의 상관을 보여 성능 개선 근거로 설명 가능", "현재 Top10 결과에서 활성화되지 않음",
    "활성화되지만 단독 hit 상관은 제한적",
)
EVAL_KS = [1, 3, 5, 10]
