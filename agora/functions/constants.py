"""Fixed values that must equal the analysed application's for right results.

Everything in this module is data, stated plainly and in natural order.
"""

# --- fixed values: expertise ranks (unknown / missing -> 0) -------------------
EXPERTISE_RANKS = {
    "Novice": 1,
    "Contributor": 2,
    "Expert": 3,
    "Master": 4,
    "Grandmaster": 5,
}

# --- fixed values: medal boosts (unknown / missing -> 0) ----------------------
MEDAL_BOOST = {
    "bronze": 1,
    "silver": 2,
    "gold": 3,
    "platinum": 4,
}

# --- fixed values: knowledge-domain taxonomy (domain -> tags) -----------------
DOMAIN_TAGS = {
    "AI": [
        "AI", "Artificial Intelligence",
        "ML", "Machine Learning", "Machine Learning Ethics",
        "NLP", "Natural Language Processing", "LLM", "Large Language Model",
        "TRANSFORMERS", "Transformers", "Transformers Models", "Transformers Architecture", "GPT", "BERT",
        "CV", "Computer Vision",
        "DL", "Deep Learning",
        "RL", "Reinforcement Learning",
        "PCA", "Dimensionality Reduction",
        "Logistic Regression", "Softmax", "Classification", "Regression", "Linear Regression",
        "Clustering", "K-Means", "Hierarchical Clustering", "KNN",
        "Decision Tree", "randomForest", "XGBoost", "LightGBM", "Gradient Boosting",
        "SVM", "Support Vector Machine", "Ensembling", "Naive Bayes", "Multilabel Classification",
    ],
    "Data Science": [
        "DS", "Data Science",
        "DA", "Data Analysis", "Data Analytics", "Data visualization",
        "Data wrangling", "Data cleaning",
        "DM", "Data Mining",
        "DB", "Database",
        "EDA", "Exploratory Data Analysis",
        "SQL", "NoSQL",
        "Hadoop", "HDFS", "Hive", "Spark",
    ],
    "Computer Science": [
        "programming", "programming languages",
        "CS", "Computer Science",
        "OS", "Operating System",
        "DSA", "Data Structures and Algorithms",
        "Algo", "Algorithms",
        "OOP", "Object Oriented Programming",
        "CPP", "C++",
        "Java", "JavaScript",
        "Python", "R", "Scala",
    ],
    "Hardware": [
        "HD", "Hardware",
        "CPU", "GPU", "TPU",
    ],
    "Cloud Computing": [
        "Cloud", "Cloud Computing",
        "AWS", "Azure", "GCP", "Google Cloud Platform",
        "K8S", "Kubernetes",
        "Docker", "Containerization",
        "Serverless",
    ],
    "Levels": [
        "Beginner", "Intermediate", "Advanced", "Expert",
    ],
    "Healthcare": [
        "Healthcare", "Health", "Health Informatics",
        "Bioinformatics", "Genomics",
        "Medical Imaging", "Radiology",
        "Clinical Data", "Electronic Health Records",
        "Telemedicine", "Telehealth",
        "Wearable Technology",
    ],
    "Finance": [
        "Finance", "Fintech",
        "Investment", "Investing",
        "Trading", "Stock Market",
        "Cryptocurrency", "Blockchain",
        "Risk Management", "Portfolio Management",
        "Quantitative Finance",
    ],
    "Banking": [
        "Banking", "Bank",
        "Retail Banking", "Commercial Banking",
        "Investment Banking",
        "Corporate Banking",
        "Wealth Management",
        "Private Banking",
    ],
    "Cybersecurity": [
        "Cybersecurity", "Security",
        "Network Security", "Application Security",
        "Information Security",
        "Cryptography",
        "Incident Response",
        "Threat Intelligence",
        "Vulnerability Management",
    ],
    "DevOps": [
        "DevOps", "Development Operations",
        "CI/CD", "Continuous Integration", "Continuous Deployment",
        "Agile", "Scrum",
        "Version Control", "Git",
        "Infrastructure as Code",
        "Monitoring and Logging",
    ],
    "Electricity": [
        "Electricity", "Power Systems",
        "Renewable Energy", "Solar Energy", "Wind Energy",
        "Energy Storage", "Batteries",
        "Smart Grid",
        "Energy Management",
        "Power Electronics", "Energy",
    ],
}
GENERAL_DOMAIN = "General"

# --- fixed values: technical phrases joined before tokenizing -----------------
TECH_PHRASES = [
    "machine learning", "deep learning", "natural language processing",
    "data science", "feature engineering", "computer vision",
]

# --- fixed values: English stop-word list (the public NLTK English list) ------
ENGLISH_STOPWORDS = [
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "you're",
    "you've", "you'll", "you'd", "your", "yours", "yourself", "yourselves", "he",
    "him", "his", "himself", "she", "she's", "her", "hers", "herself", "it", "it's",
    "its", "itself", "they", "them", "their", "theirs", "themselves", "what", "which",
    "who", "whom", "this", "that", "that'll", "these", "those", "am", "is", "are",
    "was", "were", "be", "been", "being", "have", "has", "had", "having", "do",
    "does", "did", "doing", "a", "an", "the", "and", "but", "if", "or", "because",
    "as", "until", "while", "of", "at", "by", "for", "with", "about", "against",
    "between", "into", "through", "during", "before", "after", "above", "below",
    "to", "from", "up", "down", "in", "out", "on", "off", "over", "under", "again",
    "further", "then", "once", "here", "there", "when", "where", "why", "how", "all",
    "any", "both", "each", "few", "more", "most", "other", "some", "such", "no",
    "nor", "not", "only", "own", "same", "so", "than", "too", "very", "s", "t",
    "can", "will", "just", "don", "don't", "should", "should've", "now", "d", "ll",
    "m", "o", "re", "ve", "y", "ain", "aren", "aren't", "couldn", "couldn't",
    "didn", "didn't", "doesn", "doesn't", "hadn", "hadn't", "hasn", "hasn't",
    "haven", "haven't", "isn", "isn't", "ma", "mightn", "mightn't", "mustn",
    "mustn't", "needn", "needn't", "shan", "shan't", "shouldn", "shouldn't", "wasn",
    "wasn't", "weren", "weren't", "won", "won't", "wouldn", "wouldn't",
]
# analysis stop list keeps these question words
ANALYSIS_KEEP = ["what", "how", "when", "why", "which", "where"]
# tuning stop list keeps these and adds the extra words
TUNING_KEEP = ["how", "what", "why", "when", "which", "where", "many"]
TUNING_EXTRA = ["hi", "also", "use", "like"]

# --- fixed values: the 20 argument-quality tasks and their weights ------------
QUALITY_TASK_WEIGHTS = [
    ("relevance", 0.20908452),
    ("fact", 0.18285757),
    ("opinion", -0.11069402),
    ("justification", 0.29000763),
    ("solproposal", 0.39535126),
    ("addknowledge", 0.14655912),
    ("question", -0.07331445),
    ("refusers", -0.03768367),
    ("refmedium", 0.07019062),
    ("refcontents", -0.02847408),
    ("refpersonal", 0.21126469),
    ("refformat", -0.02674237),
    ("address", 0.01482095),
    ("respect", 0.00732909),
    ("screaming", -0.01900971),
    ("vulgar", -0.04995486),
    ("insult", -0.05884586),
    ("sarcasm", -0.15170863),
    ("discrimination", 0.02934227),
    ("storytelling", 0.10628146),
]
QUALITY_SCORE_MIN = -1.66928295
QUALITY_SCORE_MAX = 4.98926754
QUALITY_SCORE_BOUND = 5

# --- fixed values: score / band / threshold defaults --------------------------
DELIQ_INITIAL_WEIGHTS = (0.65, 0.15, 0.20)
BAND_TYPICAL_BELOW = 1.0
BAND_ATYPICAL_FROM = 1.45
HEADER_TYPICAL_BELOW = 0.5
HEADER_ATYPICAL_FROM = 1.5
BAND_LABELS = ("Típico", "Moderado", "Atípico")
ENGAGEMENT_COMMENT_WEIGHT = 1.5
ENGAGEMENT_DEPTH_WEIGHT = 1.2
PAGERANK_ALPHA = 0.85
PAGERANK_MAX_ITER = 100
PAGERANK_TOL = 1.0e-6
APPRECIATION_BOOST = 1.0
NON_APPRECIATION_BOOST = 0.01
RECENCY_FLOOR = 0.1
DBSCAN_EPS = 0.7
DBSCAN_MIN_SAMPLES = 10
HOPKINS_SAMPLE_RATIO = 0.3
RANDOM_STATE = 42


#: fixed values: English nouns whose singular no plural rule gives
LEMMA_EXCEPTIONS = {
    "news": "news", "series": "series", "species": "species", "means": "means", "lens": "lens", "physics": "physics",
    "mathematics": "mathematics", "statistics": "statistics", "analytics": "analytics", "always": "always",
    "dies": "die", "lies": "lie", "ties": "tie", "pies": "pie", "movies": "movie", "cookies": "cookie", "zombies": "zombie",
    "men": "man", "women": "woman", "children": "child", "people": "people", "feet": "foot", "teeth": "tooth", "geese": "goose",
    "mice": "mouse", "oxen": "ox", "lives": "life", "wives": "wife", "knives": "knife", "leaves": "leaf", "halves": "half",
    "selves": "self", "shelves": "shelf", "wolves": "wolf", "thieves": "thief", "heroes": "hero", "potatoes": "potato",
    "tomatoes": "tomato", "echoes": "echo", "quizzes": "quiz", "matrices": "matrix", "vertices": "vertex", "indices": "index",
    "axes": "axis", "analyses": "analysis", "hypotheses": "hypothesis", "crises": "crisis", "theses": "thesis",
    "criteria": "criterion", "phenomena": "phenomenon",
}
