"""Values that are part of the results: labels, word pools, label maps, limits.

Fixed values: everything in this module must keep these exact contents, since
outputs are compared with them.
"""

# The 26 standard labels, in vocabulary order.
STANDARD_LABELS = [
    "SURNAME", "FIRSTNAME", "BUILDINGNUM", "DATEOFBIRTH", "EMAIL", "PHONENUMBER", "CITY",
    "URL", "COMPANYNAME", "STATE", "ZIP", "STREET", "COUNTRY", "SSN", "DRIVERLICENSENUM",
    "PASSPORTID", "NATIONALID", "IDCARDNUM", "TAXNUM", "LICENSEPLATENUM", "PASSWORD", "IBAN",
    "AGE", "SECURITYTOKEN", "CREDITCARDNUMBER", "USERNAME",
]

# Selection weight of a label; all others weigh 0.1.
LABEL_CHANCE = {"SURNAME": 0.5, "FIRSTNAME": 0.5}
DEFAULT_CHANCE = 0.1

# Labels that are always selected together.
ADDRESS_LABELS = ["BUILDINGNUM", "CITY", "STATE", "ZIP", "COUNTRY", "STREET"]

# Coreference markers, not personal data.
MARKER_LABELS = ["PRONOUN", "REFERENCE", "MENTION", "pronoun", "reference"]

# Mentions that count as pronouns when no type is given.
PRONOUNS = [
    "i", "me", "my", "he", "she", "him", "her", "they", "them", "their", "it", "its", "we",
    "us", "our", "you", "your",
]

# Languages and the countries they are sampled with.
LANGUAGE_COUNTRIES = {
    "English": ["United States", "United Kingdom", "Canada", "Australia", "Ireland", "New Zealand"],
    "German": ["Germany", "Austria", "Switzerland"],
    "French": ["France", "Belgium", "Canada", "Switzerland", "Luxembourg"],
    "Spanish": ["Spain", "Mexico", "Argentina", "Colombia", "Peru", "Chile"],
    "Dutch": ["Netherlands", "Belgium"],
    "Danish": ["Denmark"],
}

# Foreign label -> standard label.
FOREIGN_LABELS = {
    "GIVENNAME1": "FIRSTNAME", "GIVENNAME2": "FIRSTNAME",
    "LASTNAME1": "SURNAME", "LASTNAME2": "SURNAME", "LASTNAME3": "SURNAME",
    "EMAIL": "EMAIL", "TEL": "PHONENUMBER", "USERNAME": "USERNAME",
    "BUILDING": "BUILDINGNUM", "STREET": "STREET", "SECADDRESS": "STREET", "CITY": "CITY",
    "STATE": "STATE", "POSTCODE": "ZIP", "COUNTRY": "COUNTRY",
    "BOD": "DATEOFBIRTH", "SOCIALNUMBER": "SSN", "DRIVERLICENSE": "DRIVERLICENSENUM",
    "PASSPORT": "PASSPORTID", "IDCARD": "NATIONALID", "PASS": "PASSWORD",
}
# Foreign labels without a counterpart; their entities are dropped.
FOREIGN_DROPPED = ["CARDISSUER", "DATE", "GEOCOORD", "IP", "SEX", "TIME", "TITLE"]

# Limits.
MAX_TOKENS = 512
CHUNK_OVERLAP = 64
DEFAULT_THRESHOLD = 0.25
THRESHOLD_RANGE = (0.05, 0.95)
MAX_LOG_MESSAGE = 50 * 1024
LOG_PAGE_DEFAULT = 100
LOG_PAGE_MAX = 500
MAX_LOG_ROWS = 5000
MAX_VAULT_ROWS = 10000
IGNORE_ID = -100

# Characters that join the parts of one entity.
JOINER_CHARS = ".,@_-+:/#%&="

# Order of the four audit rows of a transaction.
DIRECTIONS = ["request_original", "request_masked", "response_masked", "response_original"]

# Paths and host suffixes of the chat providers.
PROVIDERS = ["openai", "anthropic", "gemini", "mistral", "custom"]
PROVIDER_PATHS = {"/v1/chat/completions": "openai", "/v1/messages": "anthropic"}
GEMINI_PATH_PREFIX = "/v1beta/models"
PROVIDER_HOSTS = {
    "openai": "api.openai.com", "anthropic": "api.anthropic.com",
    "gemini": "generativelanguage.googleapis.com", "mistral": "api.mistral.ai",
}

# Fields of a request that hold what people wrote, and keys whose values only name things.
TEXT_FIELDS = ["messages", "contents", "system", "system_instruction", "systemInstruction"]
NAMING_KEYS = ["type", "role", "media_type"]

# Word pools of the dummy generators.
EMAIL_FIRST = [
    "jane", "john", "alex", "sam", "taylor", "casey", "jordan", "riley", "michael", "sarah",
    "david", "emily", "james", "emma", "robert", "olivia", "wei", "mei", "hiroshi", "yuki", "jin",
    "min", "raj", "priya", "amara", "kofi", "zara", "kwame", "nia", "jelani", "yusuf", "fatima",
    "omar", "layla", "ali", "nadia", "carlos", "maria", "diego", "sofia", "miguel", "lucia",
    "dmitri", "anna", "ivan", "katya", "alexei", "elena",
]
EMAIL_LAST = [
    "doe", "smith", "johnson", "brown", "davis", "wilson", "moore", "taylor", "anderson", "thomas",
    "jackson", "white", "harris", "martin", "thompson", "chen", "wang", "kim", "nguyen", "tanaka",
    "yamamoto", "patel", "singh", "okonkwo", "diallo", "mensah", "osei", "abebe", "mohammed",
    "ahmed", "hassan", "khan", "ali", "garcia", "rodriguez", "martinez", "lopez", "gonzalez",
    "hernandez", "ivanov", "petrov", "kowalski", "novak", "horvat", "obrien", "murphy", "kelly",
    "sullivan",
]
EMAIL_DOMAINS = [
    "example.com", "example.org", "example.net", "test.com", "test.org", "test.net", "invalid.com",
    "invalid.org",
]
USERNAME_PREFIXES = [
    "user", "person", "member", "account", "demo", "guest", "customer", "client", "visitor",
    "subscriber", "participant", "contributor", "associate", "testuser", "sample",
]
STREETS = [
    "Main St", "Oak Ave", "Maple Dr", "Park Blvd", "Elm Street", "Pine Road", "Cedar Lane",
    "Washington St", "Broadway", "Market St", "Church St", "Mill Road", "School Lane", "Lake Ave",
    "River Road", "Highland Ave", "Forest Dr", "Valley Road", "Sunset Blvd", "Spring St",
    "Garden Way", "Lincoln Ave", "Jefferson St", "Franklin Blvd", "Madison Ave", "Monroe Dr",
    "High Street", "Station Road", "Church Lane", "Victoria Road", "Queens Road", "King Street",
    "Manor Road", "Park Lane", "The Crescent", "Green Lane", "Mill Lane", "New Road",
    "Chapel Street", "West End", "North Terrace",
]
CITIES = [
    "Springfield", "Riverside", "Greenville", "Fairview", "Madison", "Georgetown", "Salem",
    "Arlington", "Franklin", "Clinton", "Bristol", "Chester", "Dayton", "Kingston", "Newport",
    "Oakland", "Plymouth", "Burlington", "Manchester", "Lexington", "Milton", "Ashland", "Clayton",
    "Toronto", "Vancouver", "Calgary", "Ottawa", "Edmonton", "Winnipeg", "Halifax", "Victoria",
    "Regina", "Saskatoon", "Hamilton", "Kitchener", "London", "Windsor", "Birmingham", "Edinburgh",
    "Liverpool", "Leeds", "Sheffield", "Newcastle", "Nottingham", "Southampton", "Portsmouth",
    "Oxford", "Cambridge", "York", "Bath", "Brighton", "Cardiff", "Belfast", "Glasgow", "Aberdeen",
    "Dundee", "Swansea",
]
FIRST_NAMES = [
    "John", "Jane", "Michael", "Sarah", "David", "Emily", "James", "Emma", "Robert", "Olivia",
    "William", "Elizabeth", "Richard", "Jennifer", "Thomas", "Jessica", "Charles", "Amanda",
    "Christopher", "Ashley", "Daniel", "Stephanie", "Matthew", "Nicole", "Anthony", "Melissa",
    "Wei", "Mei", "Hiroshi", "Yuki", "Jin", "Min", "Raj", "Priya", "Kenji", "Sakura", "Chen", "Li",
    "Aiko", "Takeshi", "Ananya", "Arjun", "Amara", "Kofi", "Zara", "Kwame", "Nia", "Jelani",
    "Amina", "Chioma", "Oluwaseun", "Aisha", "Tariq", "Imani", "Sekou", "Adaeze", "Yusuf", "Fatima",
    "Omar", "Layla", "Ali", "Nadia", "Hassan", "Mariam", "Khalid", "Zahra", "Ahmed", "Leila",
    "Ibrahim", "Yasmin", "Carlos", "Maria", "Diego", "Sofia", "Miguel", "Lucia", "Alejandro",
    "Valentina", "Fernando", "Camila", "Ricardo", "Isabella", "Andres", "Gabriela", "Dmitri",
    "Anna", "Ivan", "Katya", "Alexei", "Elena", "Nikolai", "Olga", "Sergei", "Natasha", "Vladimir",
    "Irina", "Mikhail", "Tatiana",
]
SURNAMES = [
    "Smith", "Johnson", "Williams", "Brown", "Jones", "Garcia", "Miller", "Davis", "Martinez",
    "Wilson", "Anderson", "Taylor", "Thomas", "Moore", "Jackson", "Martin", "Lee", "Thompson",
    "White", "Harris", "Clark", "Lewis", "Robinson", "Walker", "Hall", "Young", "King", "Wright",
    "Hill", "Scott", "Chen", "Wang", "Li", "Zhang", "Liu", "Kim", "Park", "Choi", "Nguyen", "Tran",
    "Tanaka", "Yamamoto", "Suzuki", "Watanabe", "Patel", "Singh", "Sharma", "Kumar", "Okonkwo",
    "Diallo", "Mensah", "Osei", "Abebe", "Adeyemi", "Nkosi", "Mbeki", "Kamara", "Toure", "Dlamini",
    "Ndlovu", "Mohammed", "Ahmed", "Hassan", "Khan", "Ali", "Ibrahim", "Hussein", "Malik", "Nazari",
    "Hosseini", "Rahman", "Begum", "Rodriguez", "Lopez", "Gonzalez", "Hernandez", "Perez",
    "Sanchez", "Ramirez", "Torres", "Flores", "Rivera", "Gomez", "Diaz", "Reyes", "Morales", "Cruz",
    "Ortiz", "Ivanov", "Petrov", "Kowalski", "Novak", "Horvat", "Popov", "Volkov", "Kozlov",
    "Nowak", "Kovalenko", "Bondarenko", "Shevchenko", "O'Brien", "Murphy", "Kelly", "Sullivan",
    "O'Connor", "Walsh", "Ryan", "Byrne", "MacDonald", "Campbell", "Stewart", "Murray", "Fraser",
    "MacLeod",
]
URL_DOMAINS = [
    "example", "test", "invalid", "localhost",
]
URL_TLDS = [
    "com", "org", "net", "edu", "gov", "info", "biz", "co", "io", "dev",
]
URL_PATHS = [
    "", "/page", "/info", "/about", "/contact", "/data", "/home", "/products", "/services",
    "/support", "/help", "/faq", "/terms", "/privacy", "/account", "/dashboard",
]
COMPANY_PREFIXES = [
    "Acme", "Global", "United", "Pacific", "Atlantic", "Northern", "Summit", "Horizon", "Apex",
    "Vanguard", "Pinnacle", "Premier", "Elite", "Prime", "Sterling", "Meridian", "Coastal",
    "Central", "National", "Continental", "Metro", "Allied", "Dynamic", "Synergy", "Fusion",
    "Vertex", "Quantum", "Nova", "Titan", "Omega", "Pioneer", "Frontier", "Legacy", "Heritage",
    "Keystone", "Benchmark", "Catalyst", "Spectrum", "Nexus", "Compass",
]
COMPANY_SUFFIXES = [
    "Inc", "LLC", "Corp", "Industries", "Solutions", "Group", "Holdings", "Partners",
    "Enterprises", "Co", "Technologies", "Systems", "Services", "Consulting", "Associates",
    "International", "Worldwide", "Ltd", "PLC", "Limited", "GmbH", "AG", "SA", "SL", "Pty Ltd",
]
STATES = [
    "Alabama", "Alaska", "Arizona", "Arkansas", "California", "Colorado", "Connecticut",
    "Delaware", "Florida", "Georgia", "Hawaii", "Idaho", "Illinois", "Indiana", "Iowa", "Kansas",
    "Kentucky", "Louisiana", "Maine", "Maryland", "Massachusetts", "Michigan", "Minnesota",
    "Mississippi", "Missouri", "Montana", "Nebraska", "Nevada", "New Hampshire", "New Jersey",
    "New Mexico", "New York", "North Carolina", "North Dakota", "Ohio", "Oklahoma", "Oregon",
    "Pennsylvania", "Rhode Island", "South Carolina", "South Dakota", "Tennessee", "Texas", "Utah",
    "Vermont", "Virginia", "Washington", "West Virginia", "Wisconsin", "Wyoming",
    "Ontario", "Quebec", "British Columbia", "Alberta", "Manitoba", "Saskatchewan", "Nova Scotia",
    "New Brunswick", "Newfoundland and Labrador", "Prince Edward Island",
    "England", "Scotland", "Wales", "Northern Ireland",
    "Yorkshire", "Kent", "Essex", "Hampshire", "Surrey", "Lancashire", "Devon", "Cornwall",
    "Oxfordshire", "Cambridgeshire", "Berkshire", "Somerset", "Dorset", "Wiltshire", "Norfolk",
    "Suffolk",
]
COUNTRIES = [
    "United States", "Canada", "Mexico",
    "United Kingdom", "Germany", "France", "Italy", "Spain", "Netherlands", "Belgium",
    "Switzerland", "Austria", "Sweden", "Norway", "Denmark", "Finland", "Ireland", "Poland",
    "Portugal", "Greece", "Czech Republic", "Hungary", "Romania",
    "Japan", "China", "South Korea", "India", "Singapore", "Thailand", "Vietnam", "Indonesia",
    "Malaysia", "Philippines", "Taiwan", "Hong Kong", "Australia", "New Zealand",
    "Brazil", "Argentina", "Chile", "Colombia", "Peru",
    "South Africa", "Nigeria", "Kenya", "Egypt", "Morocco", "Ghana",
    "United Arab Emirates", "Israel", "Saudi Arabia", "Turkey",
]
IBAN_COUNTRIES = [
    "DE", "FR", "GB", "ES", "IT", "NL", "BE", "AT", "CH", "LU", "IE", "PT", "SE", "DK", "FI", "NO",
    "PL", "CZ", "HU", "RO", "BG", "SK", "SI", "HR", "RS", "UA", "GR", "CY", "MT", "EE", "LV", "LT",
    "AE", "SA", "IL", "TR",
]
PASSWORD_CHARS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789!@#$%"
TOKEN_CHARS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
TOKEN_PREFIXES = [
    "sk_live_", "sk_test_", "pk_live_", "pk_test_", "api_", "token_", "key_", "secret_", "access_",
    "auth_", "ghp_", "gho_", "ghs_", "xoxb_", "xoxp_", "xoxa_", "AKIA", "ABIA", "ACCA", "bearer_",
    "pat_", "apikey_",
]
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
GENERIC_DUMMY = "[REDACTED]"
