"""Word lists and tables whose values are part of the results."""

# Role categories, experience levels, company stages.
ROLES = ("ml_engineer", "data_scientist", "ai_engineer", "mlops_engineer", "nlp_engineer", "computer_vision_engineer", "research_scientist", "applied_scientist", "data_engineer", "ai_safety_researcher", "ai_product_manager", "other")
STAGES = ("seed", "series_a", "series_b", "series_c", "series_d_plus", "growth", "enterprise", "nonprofit", "government", "recently_funded", "acquired", "public", "unknown")

# Words that mark a posting as an AI role.
AI_KEYWORDS = ("machine learning", "ml engineer", "ai engineer", "data scientist", "llm", "nlp", "computer vision", "deep learning", "pytorch", "mlops", "research scientist", "applied scientist", "generative ai")

# Location patterns in order of precedence, with their canonical place.
CITIES = (
    ("london", "London"), ("city of london", "London"), ("greater london", "London"), ("manchester", "Manchester"), ("salford", "Manchester"),
    ("edinburgh", "Edinburgh"), ("glasgow", "Glasgow"), ("cambridge", "Cambridge"), ("oxford", "Oxford"), ("bristol", "Bristol"),
    ("birmingham", "Birmingham"), ("leeds", "Leeds"), ("sheffield", "Sheffield"), ("remote", "Remote"), ("uk remote", "Remote"), ("remote uk", "Remote"),
    ("hybrid", "Hybrid"), ("home working", "Remote"), ("reading", "Reading"), ("guildford", "Guildford"), ("brighton", "Brighton"),
)

# Technology stacks and the words that speak for them.
ARCHETYPES = {
    "LLM/Agent Stack": ("langchain", "langgraph", "openai", "gemini", "rag", "anthropic claude"),
    "Classical MLOps Stack": ("mlflow", "kubeflow", "airflow", "scikit-learn", "lightgbm", "xgboost"),
    "Deep Learning Stack": ("pytorch", "tensorflow", "jax", "hugging face", "bert", "sbert"),
    "Computer Vision Stack": ("opencv", "yolo", "detectron2", "pytorch", "computer vision"),
    "Data Engineering Stack": ("spark", "kafka", "dbt", "databricks", "snowflake", "bigquery"),
    "Cloud ML Stack": ("aws", "gcp", "azure", "kubernetes", "docker", "sagemaker"),
}

# Skills that a role implies where a posting says too little.
IMPLIED = {
    "ml_engineer": (("Python", "language"), ("PyTorch", "dl_framework"), ("scikit-learn", "ml_library"), ("SQL", "language"), ("Docker", "infra"), ("NumPy", "data_analysis")),
    "ai_engineer": (("Python", "language"), ("PyTorch", "dl_framework"), ("LangChain", "llm_framework"), ("Docker", "infra"), ("REST API", "backend"), ("SQL", "language")),
    "data_scientist": (("Python", "language"), ("scikit-learn", "ml_library"), ("SQL", "language"), ("Pandas", "data_analysis"), ("NumPy", "data_analysis"), ("Matplotlib", "visualisation")),
    "mlops_engineer": (("Python", "language"), ("Kubernetes", "infra"), ("Docker", "infra"), ("MLflow", "mlops"), ("CI/CD", "devops"), ("Terraform", "infra")),
    "nlp_engineer": (("Python", "language"), ("PyTorch", "dl_framework"), ("Hugging Face", "llm_framework"), ("BERT", "nlp"), ("spaCy", "nlp"), ("SQL", "language")),
    "computer_vision_engineer": (("Python", "language"), ("PyTorch", "dl_framework"), ("OpenCV", "computer_vision"), ("NumPy", "data_analysis"), ("Docker", "infra")),
    "research_scientist": (("Python", "language"), ("PyTorch", "dl_framework"), ("JAX", "dl_framework"), ("NumPy", "data_analysis"), ("SQL", "language")),
    "applied_scientist": (("Python", "language"), ("PyTorch", "dl_framework"), ("scikit-learn", "ml_library"), ("SQL", "language"), ("Pandas", "data_analysis")),
    "data_engineer": (("Python", "language"), ("SQL", "language"), ("Apache Spark", "data_engineering"), ("dbt", "data_engineering"), ("Docker", "infra"), ("Airflow", "mlops")),
    "ai_safety_researcher": (("Python", "language"), ("PyTorch", "dl_framework"), ("RLHF", "llm_technique"), ("NumPy", "data_analysis")),
    "ai_product_manager": (("Python", "language"), ("SQL", "language")),
    "other": (("Python", "language"), ("SQL", "language")),
}

# Sectors for exact overlap, with words and sponsorship rates.
SECTORS_EXACT = {
    "FinTech": (("python", "ml", "xgboost", "sql", "pandas", "risk"), 0.35),
    "HealthTech": (("python", "deep learning", "pytorch", "medical", "nlp"), 0.28),
    "AI Safety": (("python", "pytorch", "research", "alignment", "rl"), 0.45),
    "Autonomous Systems": (("pytorch", "computer vision", "ros", "c++", "sensors"), 0.52),
    "Enterprise AI": (("python", "llm", "langchain", "fastapi", "docker"), 0.30),
}

# Sectors for words contained in skills.
SECTORS_CONTAINED = {
    "FinTech": ("python", "mlops", "fraud detection", "sql", "data science"),
    "HealthTech": ("deep learning", "computer vision", "pytorch", "medical imaging"),
    "AI Safety": ("alignment", "rlhf", "interpretability", "safety"),
    "Enterprise AI": ("llm", "langchain", "langgraph", "rag", "fastapi", "aws"),
    "Research": ("pytorch", "research", "arxiv", "experiments", "nlp"),
    "Robotics": ("ros", "computer vision", "reinforcement learning", "slam"),
}

# Spellings of experience levels.
LEVELS = {"entry": "junior", "graduate": "junior", "grad": "junior", "mid-level": "mid", "intermediate": "mid", "sr": "senior", "sr.": "senior", "lead": "senior", "principal": "senior", "staff": "senior"}

# Terms that a report must not lean on.
RISKY = ("age", "young", "old", "male", "female", "nationality", "accent", "religion")

# Companies whose career pages are always looked at, with page and stage.
SEEDS = (
    ("Wayve", "https://wayve.ai/careers", "series_c"), ("Synthesia", "https://www.synthesia.io/careers", "series_d_plus"), ("Tractable", "https://tractable.ai/careers", "series_d_plus"),
    ("PolyAI", "https://poly.ai/careers", "series_c"), ("Quantexa", "https://www.quantexa.com/careers", "series_d_plus"), ("ElevenLabs", "https://elevenlabs.io/careers", "series_c"),
    ("Darktrace", "https://www.darktrace.com/careers", "public"), ("Graphcore", "https://www.graphcore.ai/careers", "series_e"), ("Exscientia", "https://www.exscientia.ai/careers", "public"),
    ("Thought Machine", "https://thoughtmachine.net/careers", "series_d_plus"), ("Cohere", "https://cohere.com/careers", "series_c"), ("incident.io", "https://incident.io/careers", "series_b"),
    ("V7 Labs", "https://www.v7labs.com/careers", "series_b"), ("PhysicsX", "https://www.physicsx.ai/careers", "series_b"), ("Featurespace", "https://www.featurespace.com/careers", "series_d_plus"),
    ("Speechmatics", "https://www.speechmatics.com/company/careers", "series_b"), ("Luminance", "https://www.luminance.com/careers", "series_b"), ("Oxa", "https://oxa.tech/careers", "series_b"),
    ("Healx", "https://healx.io/about/careers", "series_b"), ("BenevolentAI", "https://benevolent.ai/careers", "series_c"), ("Reka AI", "https://reka.ai/careers", "series_b"),
    ("Monolith AI", "https://www.monolith.ai/careers", "series_b"), ("Signal AI", "https://www.signal-ai.com/careers", "series_c"), ("Mind Foundry", "https://www.mindfoundry.ai/careers", "series_b"),
    ("Seldon", "https://www.seldon.io/careers", "series_b"), ("Stability AI", "https://stability.ai/careers", "series_c"), ("Poolside AI", "https://www.poolside.ai/careers", "series_a"),
    ("Humanloop", "https://humanloop.com/careers", "series_a"), ("Causaly", "https://www.causaly.com/careers", "series_a"), ("Faculty AI", "https://faculty.ai/careers", "series_b"),
    ("Conjecture", "https://conjecture.dev/careers", "seed"), ("Apollo Research", "https://apolloresearch.ai/careers", "seed"), ("Gradient Labs", "https://www.gradientlabs.ai/careers", "seed"),
    ("Cleo", "https://web.meetcleo.com/careers", "series_c"), ("Monzo", "https://monzo.com/careers", "growth"),
)

#: Our own taxonomy: canonical skill, category, aliases in lower case (the canonical name is one too).
SKILLS = (
    ("Python", "language", ()), ("SQL", "language", ()), ("R", "language", ()), ("Java", "language", ()), ("Scala", "language", ()), ("Go", "language", ("golang",)),
    ("C++", "language", ("cpp",)), ("Rust", "language", ()), ("Julia", "language", ()), ("TypeScript", "language", ("ts",)), ("Bash", "language", ("shell",)),
    ("PyTorch", "dl_framework", ("torch",)), ("TensorFlow", "dl_framework", ("tf",)), ("JAX", "dl_framework", ()), ("Keras", "dl_framework", ()),
    ("scikit-learn", "ml_library", ("sklearn",)), ("XGBoost", "ml_library", ("xgb",)), ("LightGBM", "ml_library", ("lgbm",)), ("CatBoost", "ml_library", ()),
    ("LangChain", "llm_framework", ()), ("LangGraph", "llm_framework", ()), ("LlamaIndex", "llm_framework", ("llama index",)), ("Hugging Face", "llm_framework", ("huggingface",)),
    ("RAG", "llm_technique", ("retrieval augmented generation",)), ("RLHF", "llm_technique", ()), ("LoRA", "llm_technique", ()), ("Prompt Engineering", "llm_technique", ()),
    ("BERT", "nlp", ()), ("spaCy", "nlp", ()), ("NLP", "nlp", ("natural language processing",)), ("OpenCV", "computer_vision", ()), ("YOLO", "computer_vision", ()),
    ("Computer Vision", "computer_vision", ()), ("MLflow", "mlops", ()), ("Kubeflow", "mlops", ()), ("Airflow", "mlops", ("apache airflow",)), ("MLOps", "mlops", ()),
    ("Docker", "infra", ()), ("Kubernetes", "infra", ("k8s",)), ("Terraform", "infra", ()), ("AWS", "cloud", ("amazon web services",)), ("GCP", "cloud", ("google cloud",)),
    ("Azure", "cloud", ()), ("SageMaker", "cloud", ()), ("Apache Spark", "data_engineering", ("spark", "pyspark")), ("Kafka", "data_engineering", ("apache kafka",)),
    ("dbt", "data_engineering", ()), ("Snowflake", "data_engineering", ()), ("Databricks", "data_engineering", ()), ("BigQuery", "data_engineering", ()),
    ("Pandas", "data_analysis", ()), ("NumPy", "data_analysis", ()), ("Matplotlib", "visualisation", ()), ("FastAPI", "backend", ()), ("REST API", "backend", ("rest apis",)),
    ("CI/CD", "devops", ("cicd",)), ("Git", "devops", ()), ("PostgreSQL", "database", ("postgres",)), ("Redis", "database", ()), ("Deep Learning", "ml_concept", ()),
    ("Machine Learning", "ml_concept", ("ml",)), ("Reinforcement Learning", "ml_concept", ("rl",)), ("Statistics", "ml_concept", ()),
    ("C#", "language", ()), ("MATLAB", "language", ()), ("JavaScript", "language", ("js",)), ("CUDA", "language", ()), ("Triton", "dl_framework", ()), ("ONNX", "dl_framework", ("onnxruntime",)), ("DeepSpeed", "dl_framework", ()),
    ("PyTorch Lightning", "dl_framework", ("lightning",)), ("statsmodels", "ml_library", ()), ("Optuna", "ml_library", ()), ("Ray", "ml_library", ()), ("Dask", "ml_library", ()), ("DSPy", "llm_framework", ()), ("Haystack", "llm_framework", ()),
    ("vLLM", "llm_framework", ()), ("Semantic Kernel", "llm_framework", ()), ("AutoGen", "llm_framework", ()), ("Fine-tuning", "llm_technique", ("fine tuning", "finetuning")), ("Quantisation", "llm_technique", ("quantization",)), ("Vector Search", "llm_technique", ()),
    ("NLTK", "nlp", ()), ("Gensim", "nlp", ()), ("Detectron2", "computer_vision", ()), ("SLAM", "computer_vision", ()), ("Weights & Biases", "mlops", ("wandb",)), ("DVC", "mlops", ()), ("Feast", "mlops", ()), ("Prefect", "mlops", ()),
    ("Ansible", "infra", ()), ("Helm", "infra", ()), ("Vertex AI", "cloud", ()), ("Bedrock", "cloud", ("amazon bedrock",)), ("Flink", "data_engineering", ("apache flink",)), ("Delta Lake", "data_engineering", ()), ("Redshift", "data_engineering", ()),
    ("Polars", "data_analysis", ()), ("SciPy", "data_analysis", ()), ("Plotly", "visualisation", ()), ("Tableau", "visualisation", ()), ("Power BI", "visualisation", ("powerbi",)), ("Flask", "backend", ()), ("gRPC", "backend", ()),
    ("Jenkins", "devops", ()), ("MongoDB", "database", ("mongo",)), ("Pinecone", "database", ()), ("Neo4j", "database", ()),
)
