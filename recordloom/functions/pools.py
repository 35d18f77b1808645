"""The pools that generators pick from, as they must be for the same results."""

FIRST = ["Bob", "Alice", "Carlos", "Dana", "Elena", "Frank", "Grace", "Hiro", "Ivy", "Jamal", "Kira", "Liam", "Mona", "Nia", "Omar", "Priya", "Quinn", "Rosa", "Sam", "Tara"]
LAST = ["Smith", "Johnson", "Lee", "Garcia", "Brown", "Nguyen", "Patel", "Kim", "Lopez", "Miller", "Davis", "Chen", "Walker", "Young", "Ali", "Silva", "Hansen", "Kaur", "Ortiz", "Reed"]
STREET = ["Oak St", "Maple Ave", "Cedar Ln", "Elm Dr", "Pine Rd", "Birch Blvd", "Walnut Way", "Spruce Ct", "Ash Ter", "Willow Pl"]
CITY = ["Springfield", "Riverton", "Lakeside", "Fairview", "Greenville", "Bristol", "Clinton", "Madison", "Georgetown", "Salem"]
STATE = ["California", "Texas", "New York", "Florida", "Ohio", "Georgia", "Oregon", "Nevada", "Utah", "Maine"]
STATE_ABBR = ["CA", "TX", "NY", "FL", "OH", "GA", "OR", "NV", "UT", "ME"]
COUNTRY = ["United States", "Canada", "Mexico", "Germany", "France", "Japan", "Brazil", "India", "Spain", "Italy"]
COMPANY = ["Acme Corp", "Globex", "Initech", "Umbra Labs", "Vertex LLC", "Nimbus Co", "Quanta Group", "Helix Inc", "Orbit Systems", "Zephyr Ltd"]
JOB = ["Engineer", "Analyst", "Designer", "Manager", "Consultant", "Developer", "Technician", "Director", "Specialist", "Coordinator"]
WORDS = ["alpha", "bravo", "delta", "echo", "kilo", "lima", "nova", "orion", "pixel", "quartz", "raven", "sigma", "talon", "umbra", "vector"]

#: Weighted pools: value and weight.
WEIGHTED = {
    "customerTier": [("Standard", 70), ("Premium", 20), ("Enterprise", 10)],
    "accountStatus": [("Active", 80), ("Inactive", 12), ("Suspended", 5), ("Closed", 3)],
    "leadSource": [("Web", 40), ("Referral", 20), ("Event", 15), ("Partner", 10), ("Cold Call", 8), ("Other", 7)],
    "priority": [("Low", 45), ("Medium", 35), ("High", 15), ("Critical", 5)],
    "channel": [("Email", 45), ("Phone", 25), ("Web", 18), ("Chat", 12)],
    "industry": [("Technology", 18), ("Retail", 15), ("Healthcare", 12), ("Financial Services", 11), ("Manufacturing", 10), ("Education", 8), ("Construction", 8), ("Transportation", 7), ("Energy", 6), ("Government", 5)],
    "country": [("United States", 55), ("United Kingdom", 8), ("Canada", 7), ("Germany", 6), ("France", 5), ("Australia", 4), ("India", 4), ("Japan", 3), ("Brazil", 3), ("Mexico", 3), ("Netherlands", 2)],
    "usState": [("CA", 12), ("TX", 9), ("FL", 7), ("NY", 6), ("PA", 4), ("IL", 4), ("OH", 3), ("GA", 3), ("NC", 3), ("MI", 3), ("NJ", 2), ("VA", 2), ("WA", 2), ("AZ", 2), ("MA", 2), ("OTHER", 36)],
    "emailDomain": [("gmail.com", 38), ("yahoo.com", 12), ("hotmail.com", 10), ("outlook.com", 8), ("icloud.com", 6), ("aol.com", 4), ("example.com", 22)],
    "yesNo": [("Yes", 80), ("No", 20)],
    "mostlyTrue": [("true", 90), ("false", 10)],
}

#: Regions: country, code, cities, shape of the postal code (9 a digit, A a letter, others themselves).
REGIONS = {
    "NorthAmerica": [
        ("United States", "US", ["Dallas", "Atlanta", "Phoenix", "Boston", "Denver", "Seattle"], "99999"),
        ("Canada", "CA", ["Toronto", "Vancouver", "Calgary", "Montreal", "Ottawa"], "A9A 9A9"),
        ("Mexico", "MX", ["Guadalajara", "Monterrey", "Puebla", "Mérida", "Tijuana"], "99999"),
    ],
    "LatinAmerica": [
        ("Brazil", "BR", ["São Paulo", "Rio de Janeiro", "Belo Horizonte", "Curitiba"], "99999-999"),
        ("Argentina", "AR", ["Buenos Aires", "Córdoba", "Rosario", "Mendoza"], "A9999AAA"),
        ("Chile", "CL", ["Santiago", "Valparaíso", "Concepción"], "9999999"),
        ("Colombia", "CO", ["Bogotá", "Medellín", "Cali", "Barranquilla"], "999999"),
        ("Peru", "PE", ["Lima", "Arequipa", "Trujillo"], "99999"),
    ],
    "Europe": [
        ("United Kingdom", "GB", ["Manchester", "Bristol", "Leeds", "Glasgow", "Sheffield"], "UK"),
        ("Germany", "DE", ["Munich", "Hamburg", "Cologne", "Stuttgart", "Leipzig"], "99999"),
        ("France", "FR", ["Lyon", "Marseille", "Toulouse", "Nantes", "Bordeaux"], "99999"),
        ("Spain", "ES", ["Valencia", "Seville", "Zaragoza", "Málaga", "Bilbao"], "99999"),
        ("Italy", "IT", ["Milan", "Turin", "Bologna", "Florence", "Naples"], "99999"),
        ("Netherlands", "NL", ["Rotterdam", "Utrecht", "Eindhoven", "Groningen"], "9999 AA"),
        ("Poland", "PL", ["Kraków", "Wrocław", "Poznań", "Gdańsk"], "99-999"),
        ("Sweden", "SE", ["Gothenburg", "Malmö", "Uppsala", "Västerås"], "999 99"),
    ],
    "AsiaPacific": [
        ("Japan", "JP", ["Osaka", "Nagoya", "Fukuoka", "Sapporo", "Kobe"], "999-9999"),
        ("China", "CN", ["Shanghai", "Shenzhen", "Chengdu", "Hangzhou", "Xi'an"], "999999"),
        ("India", "IN", ["Pune", "Chennai", "Jaipur", "Hyderabad", "Ahmedabad"], "999999"),
        ("Singapore", "SG", ["Singapore"], "999999"),
        ("Australia", "AU", ["Melbourne", "Brisbane", "Perth", "Adelaide"], "9999"),
        ("South Korea", "KR", ["Busan", "Incheon", "Daegu", "Daejeon"], "99999"),
    ],
    "MiddleEastAfrica": [
        ("United Arab Emirates", "AE", ["Dubai", "Abu Dhabi", "Sharjah"], ""),
        ("Saudi Arabia", "SA", ["Riyadh", "Jeddah", "Dammam"], "99999-9999"),
        ("Israel", "IL", ["Tel Aviv", "Haifa", "Jerusalem"], "9999999"),
        ("South Africa", "ZA", ["Cape Town", "Durban", "Pretoria", "Johannesburg"], "9999"),
        ("Nigeria", "NG", ["Lagos", "Abuja", "Ibadan", "Kano"], "999999"),
        ("Egypt", "EG", ["Cairo", "Alexandria", "Giza"], "99999"),
        ("Kenya", "KE", ["Nairobi", "Mombasa", "Kisumu"], "99999"),
    ],
}

#: Locales: country, first and last names, cities, street, postal and phone shapes (own short lists).
LOCALES = {
    "Japan": ("Japan", ["太郎", "花子", "健", "美咲"], ["佐藤", "鈴木", "高橋", "田中"], ["東京", "大阪", "京都"], "9丁目9-9", "999-9999", "09-9999-9999"),
    "Germany": ("Germany", ["Jürgen", "Anke", "Lukas", "Heike"], ["Müller", "Schäfer", "Weiß", "Krüger"], ["Köln", "München", "Bremen"], "Hauptstraße 99", "99999", "+49 99 9999999"),
    "France": ("France", ["Élodie", "Benoît", "Chloé", "Gérard"], ["Lefèvre", "Dubois", "Besançon", "Noël"], ["Orléans", "Nîmes", "Lille"], "99 rue de la Paix", "99999", "+33 9 99 99 99 99"),
    "Spain": ("Spain", ["José", "Begoña", "Iñigo", "Lucía"], ["Muñoz", "García", "Peña", "Ibáñez"], ["Córdoba", "León", "Cádiz"], "Calle Mayor 99", "99999", "+34 999 999 999"),
    "Italy": ("Italy", ["Giulia", "Nicolò", "Chiara", "Marco"], ["Rossi", "Bianchi", "D'Angelo", "Conti"], ["Pisa", "Verona", "Forlì"], "Via Roma 99", "99999", "+39 999 9999999"),
    "Mexico": ("Mexico", ["Ximena", "Jesús", "María", "Raúl"], ["Hernández", "Núñez", "Ramírez", "Ortega"], ["León", "Oaxaca", "Cancún"], "Avenida Juárez 99", "99999", "+52 999 999 9999"),
    "Brazil": ("Brazil", ["João", "Conceição", "Luís", "Antônia"], ["Gonçalves", "Araújo", "Souza", "Lima"], ["Recife", "Brasília", "Goiânia"], "Rua das Flores 99", "99999-999", "+55 99 99999-9999"),
    "China": ("China", ["伟", "芳", "娜", "强"], ["王", "李", "张", "刘"], ["北京", "广州", "南京"], "中山路99号", "999999", "199 9999 9999"),
    "Korea": ("South Korea", ["민준", "서연", "지훈", "하은"], ["김", "이", "박", "최"], ["서울", "수원", "제주"], "중앙로 99", "99999", "010-9999-9999"),
    "India": ("India", ["Aarav", "Diya", "Kabir", "Ananya"], ["Sharma", "Iyer", "Reddy", "Das"], ["Mumbai", "Kochi", "Surat"], "99 MG Road", "999999", "+91 99999 99999"),
    "UnitedKingdom": ("United Kingdom", ["Oliver", "Niamh", "Harry", "Isla"], ["Taylor", "O'Neill", "Hughes", "Clarke"], ["York", "Bath", "Leeds"], "99 High Street", "UK", "0999 999 9999"),
    "Canada": ("Canada", ["Ethan", "Maëlle", "Logan", "Zoé"], ["Tremblay", "Martin", "Roy", "Campbell"], ["Halifax", "Québec", "Regina"], "99 Maple Crescent", "A9A 9A9", "(999) 999-9999"),
}

NULLISH = ["NULL", "null", "N/A", "n/a", "#N/A", "-", "", "None", "(blank)", "TBD", "UNKNOWN", "?", "."]
TYPO_DOMAINS = ["gmial.com", "gmai.com", "gmail.co", "yahoo.con", "yaho.com", "hotmial.com", "hotmail.co", "outlook.con", "iclould.com"]
MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
CRM_PREFIXES = ["001", "003", "006", "00Q", "500", "701"]
ISIN_COUNTRIES = ["US", "GB", "DE", "FR", "JP", "CA", "CH", "NL", "AU"]

#: Public lists behind the flat accessors: names and codes.
LANGUAGES = [("English", "en", "eng"), ("German", "de", "deu"), ("French", "fr", "fra"), ("Spanish", "es", "spa"), ("Japanese", "ja", "jpn"), ("Swahili", "sw", "swa")]
AIRPORTS = [("Frankfurt Airport", "FRA"), ("Heathrow Airport", "LHR"), ("Haneda Airport", "HND"), ("Changi Airport", "SIN"), ("Denver International Airport", "DEN")]
AIRLINES = [("Lufthansa", "LH"), ("Qantas", "QF"), ("KLM", "KL"), ("Air Canada", "AC"), ("LATAM Airlines", "LA")]
AIRPLANES = [("Airbus A320", "320"), ("Boeing 737-800", "738"), ("Embraer 190", "E90"), ("Airbus A350", "350")]
CURRENCIES = [("US Dollar", "USD", "$", "840"), ("Euro", "EUR", "€", "978"), ("Yen", "JPY", "¥", "392"), ("Pound Sterling", "GBP", "£", "826"), ("Swiss Franc", "CHF", "$", "756")]
ELEMENTS = [("Hydrogen", "H", "1"), ("Carbon", "C", "6"), ("Oxygen", "O", "8"), ("Iron", "Fe", "26"), ("Gold", "Au", "79")]
UNITS = [("meter", "m"), ("second", "s"), ("kilogram", "kg"), ("ampere", "A"), ("kelvin", "K"), ("mole", "mol"), ("candela", "cd")]
