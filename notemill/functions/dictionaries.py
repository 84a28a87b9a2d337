"""Word lists and tables. Results depend on each of them as it stands."""

from __future__ import annotations

STOP_WORDS_EN = """the and for are but not you all can had her was one our out day get has him his how its may new now old see two who boy did she use way will with have this that from they know
want been good much some time very when come here just like long make many over such take than them well were what your about after again before could first found great other right should these
think where would write also cover document discusses includes text content""".split()

STOP_WORDS_JA = """これ それ あれ この その あの ここ そこ あそこ です である だった でした します しました という として について による によって において に関して に対して のため ので から まで など なお
また さらに ただし しかし けれど でも そして または もしくは および ならびに""".split()

TECHNICAL_TERMS = """API REST GraphQL JSON XML HTTP HTTPS SSL TLS OAuth JWT SQL NoSQL MongoDB PostgreSQL MySQL Redis Docker Kubernetes AWS Azure GCP CI/CD DevOps Git GitHub GitLab JavaScript TypeScript Python
Java C++ React Vue Angular Node.js Express Django Flask Spring Laravel""".split()

JAPANESE_TERMS = """プログラミング アルゴリズム データ構造 オブジェクト指向 関数型プログラミング デザインパターン リファクタリング テスト駆動開発 アジャイル開発 スクラム カンバン システム設計 アーキテクチャ
マイクロサービス モノリス スケーラビリティ 可用性 パフォーマンス セキュリティ 負荷分散 キャッシュ データベース設計 機械学習 深層学習 ニューラルネットワーク 自然言語処理 コンピュータビジョン 強化学習 教師あり学習
教師なし学習 特徴量エンジニアリング モデル評価 過学習 汎化性能 ビジネスモデル 戦略 マーケティング ブランディング 顧客体験 ユーザーエクスペリエンス プロダクトマネジメント プロジェクトマネジメント リーダーシップ
チームビルディング""".split()

#: (written, other spellings), applied one at a time to the original text.
LONG_VOWELS = (("ー", ("", "ウ", "ー")), ("ウ", ("ー", "", "ウ")))
CONSONANTS = (("ヴ", ("ブ", "バ")), ("ティ", ("テ",)), ("フィ", ("フ",)), ("ウィ", ("ウ",)), ("シェ", ("シエ",)), ("チェ", ("チエ",)))

#: (English, Japanese names)
PAIRS = (
    ("API", ("エーピーアイ", "アプリケーションプログラミングインターフェース")),
    ("DB", ("データベース", "ディービー")),
    ("UI", ("ユーザーインターフェース", "ユーアイ")),
    ("URL", ("ユーアールエル", "ユニフォームリソースロケータ")),
    ("HTTP", ("エイチティーティーピー", "ハイパーテキストトランスファープロトコル")),
    ("JSON", ("ジェイソン", "ジャバスクリプトオブジェクトノーテーション")),
    ("XML", ("エックスエムエル", "エクステンシブルマークアップランゲージ")),
    ("CSS", ("シーエスエス", "カスケーディングスタイルシート")),
    ("HTML", ("エイチティーエムエル", "ハイパーテキストマークアップランゲージ")),
    ("SQL", ("エスキューエル", "ストラクチャードクエリーランゲージ")),
    ("AI", ("エーアイ", "人工知能", "じんこうちのう")),
    ("ML", ("エムエル", "機械学習", "きかいがくしゅう")),
    ("DL", ("ディーエル", "深層学習", "しんそうがくしゅう")),
    ("IoT", ("アイオーティー", "モノのインターネット")),
    ("VR", ("ブイアール", "仮想現実", "かそうげんじつ")),
    ("AR", ("エーアール", "拡張現実", "かくちょうげんじつ")),
    ("OS", ("オーエス", "オペレーティングシステム")),
    ("CPU", ("シーピーユー", "中央処理装置", "ちゅうおうしょりそうち")),
    ("GPU", ("ジーピーユー", "グラフィック処理装置")),
    ("RAM", ("ラム", "メモリ", "主記憶装置")),
    ("SSD", ("エスエスディー", "ソリッドステートドライブ")),
    ("HDD", ("エイチディーディー", "ハードディスクドライブ")),
)

#: (abbreviation, variations)
ABBREVIATIONS = (
    ("DB", ("db", "データベース", "database")),
    ("RDBMS", ("rdbms", "relational database")),
    ("NoSQL", ("nosql", "non-relational database")),
    ("OOP", ("oop", "object oriented")),
    ("MVC", ("mvc", "model view controller")),
    ("REST", ("rest", "restful")),
    ("CRUD", ("crud", "create read update delete")),
    ("TCP", ("tcp", "transmission control")),
    ("UDP", ("udp", "user datagram")),
    ("DNS", ("dns", "domain name")),
    ("HTTPS", ("https", "secure http")),
    ("SSL", ("ssl", "secure socket")),
    ("TLS", ("tls", "transport security")),
    ("JWT", ("jwt", "json token")),
    ("OAuth", ("oauth", "open auth")),
)

#: (category, priority, pattern, keywords, weight)
TAG_PATTERNS = (
    ("programming_languages", 8, "python", ("python", "py", "django", "flask", "pandas", "numpy", "fastapi"), 1.2),
    ("programming_languages", 8, "javascript", ("javascript", "js", "node", "react", "vue", "angular", "npm"), 1.2),
    ("programming_languages", 8, "typescript", ("typescript", "ts", "angular", "nest", "deno"), 1.1),
    ("programming_languages", 8, "rust", ("rust", "cargo", "tokio", "serde", "actix"), 1.1),
    ("programming_languages", 8, "go", ("golang", "go", "gin", "echo", "goroutine"), 1.1),
    ("technologies", 7, "database", ("sql", "mysql", "postgresql", "mongodb", "redis", "sqlite"), 1.0),
    ("technologies", 7, "cloud", ("aws", "azure", "gcp", "docker", "kubernetes", "serverless"), 1.0),
    ("technologies", 7, "frontend", ("html", "css", "sass", "webpack", "vite", "tailwind"), 1.0),
    ("technologies", 7, "backend", ("api", "rest", "graphql", "microservice", "server"), 1.0),
    ("concepts", 6, "architecture", ("design pattern", "architecture", "microservice", "monolith", "mvc"), 0.9),
    ("concepts", 6, "algorithms", ("algorithm", "data structure", "complexity", "optimization", "sorting"), 0.9),
    ("concepts", 6, "testing", ("test", "unit test", "integration test", "tdd", "bdd", "pytest"), 0.8),
    ("japanese_content", 5, "japanese", ("日本語", "japanese", "nihongo", "katakana", "hiragana", "kanji"), 1.3),
    ("japanese_content", 5, "culture", ("文化", "culture", "tradition", "festival", "ceremony", "習慣"), 1.0),
    ("japanese_content", 5, "api", ("api", "エーピーアイ", "インターフェース", "インターフェイス", "interface"), 1.2),
    ("japanese_content", 5, "database", ("データベース", "db", "database", "ディービー"), 1.2),
    ("japanese_content", 5, "service", ("サービス", "サーヴィス", "service"), 1.1),
)

#: (wider tag, tag, keywords)
KEYWORD_TAGS = (
    ("programming-languages", "python", ("python", "py", "django", "flask", "pandas", "numpy")),
    ("programming-languages", "javascript", ("javascript", "js", "node", "react", "vue", "angular")),
    ("programming-languages", "java", ("java", "spring", "maven", "gradle")),
    ("programming-languages", "typescript", ("typescript", "ts", "angular", "nest")),
    ("programming-languages", "rust", ("rust", "cargo", "tokio")),
    ("programming-languages", "go", ("golang", "go", "gin", "echo")),
    ("technologies", "database", ("sql", "mysql", "postgresql", "mongodb", "redis")),
    ("technologies", "cloud", ("aws", "azure", "gcp", "docker", "kubernetes")),
    ("technologies", "frontend", ("html", "css", "sass", "webpack", "vite")),
    ("technologies", "backend", ("api", "rest", "graphql", "microservice")),
    ("technologies", "devops", ("ci/cd", "jenkins", "github actions", "terraform")),
    ("concepts", "architecture", ("design pattern", "architecture", "microservice", "monolith")),
    ("concepts", "algorithms", ("algorithm", "data structure", "complexity", "optimization")),
    ("concepts", "security", ("security", "authentication", "authorization", "encryption")),
    ("concepts", "testing", ("test", "unit test", "integration test", "tdd", "bdd")),
    ("japanese-content", "language", ("日本語", "japanese", "nihongo", "katakana", "hiragana", "kanji")),
    ("japanese-content", "culture", ("文化", "culture", "tradition", "festival", "ceremony")),
    ("japanese-content", "business", ("ビジネス", "business", "company", "work", "職場")),
)

#: (group, keywords, tags)
CONTENT_TAGS = (
    ("programming", ("code", "programming", "development", "software", "algorithm", "function", "class", "method"), ("programming", "development", "code")),
    ("japanese", ("日本語", "japanese", "katakana", "hiragana", "kanji"), ("japanese", "language")),
    ("architecture", ("architecture", "design", "pattern", "system", "component", "microservice"), ("architecture", "design", "system")),
    ("book", ("book", "author", "chapter", "読書", "本"), ("book", "reading")),
    ("note", ("note", "memo", "idea", "thought"), ("note", "memo")),
)

CATEGORIES = (
    ("technical", ("code", "programming", "development", "algorithm", "function", "class")),
    ("research", ("research", "study", "analysis", "investigation", "findings")),
    ("documentation", ("documentation", "guide", "tutorial", "how-to", "manual")),
    ("personal", ("diary", "personal", "reflection", "thought", "idea")),
    ("book", ("book", "reading", "author", "chapter", "読書", "本")),
    ("japanese", ("日本語", "japanese", "katakana", "hiragana", "kanji")),
)

PLACEHOLDERS = ("TODO", "FIXME", "placeholder", "coming soon", "to be written", "未完成", "作成中")
#: What a text says of itself: the words before a colon, and what stands behind it.
METADATA = {
    "author": r"(?iu)(?:author|著者|writer|written by)[:]\s*([^\n]+)",
    "source": r"(?iu)(?:source|出典|from)[:]\s*([^\n]+)",
    "date_created": r"(?iu)(?:created|作成日|date)[:]\s*(\d{4}-\d{2}-\d{2})",
    "project": r"(?iu)(?:project|プロジェクト)[:]\s*([^\n]+)",
    "status": r"(?iu)(?:status|状態)[:]\s*(draft|complete|in-progress|todo)",
}
REQUIRED_FIELDS = ("title", "aliases", "tags", "id", "published", "description", "category")
