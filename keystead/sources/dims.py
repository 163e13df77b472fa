"""Small dimension tables that the listing jobs use by default.

Each job takes its table as an argument, so a caller can pass another one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Sub-area names and the sector that replaces them, applied in this order.
SECTOR_ALIASES = [
    ("dharam colony", "sector 12"),
    ("krishna colony", "sector 7"),
    ("suncity", "sector 54"),
    ("prem nagar", "sector 13"),
    ("mg road", "sector 28"),
    ("gandhi nagar", "sector 28"),
    ("laxmi garden", "sector 11"),
    ("shakti nagar", "sector 11"),
    ("baldev nagar", "sector 7"),
    ("shivpuri", "sector 7"),
    ("garhi harsaru", "sector 17"),
    ("imt manesar", "manesar"),
    ("adarsh nagar", "sector 12"),
    ("shivaji nagar", "sector 11"),
    ("bhim nagar", "sector 6"),
    ("madanpuri", "sector 7"),
    ("saraswati vihar", "sector 28"),
    ("arjun nagar", "sector 8"),
    ("ravi nagar", "sector 9"),
    ("vishnu garden", "sector 105"),
    ("bhondsi", "sector 11"),
    ("surya vihar", "sector 21"),
    ("devilal colony", "sector 9"),
    ("valley view estate", "gwal pahari"),
    ("mehrauli  road", "sector 14"),
    ("jyoti park", "sector 7"),
    ("ansal plaza", "sector 23"),
    ("dayanand colony", "sector 6"),
    ("sushant lok phase 2", "sector 55"),
    ("chakkarpur", "sector 28"),
    ("greenwood city", "sector 45"),
    ("subhash nagar", "sector 12"),
    ("sohna road road", "sohna road"),
    ("malibu town", "sector 47"),
    ("surat nagar 1", "sector 104"),
    ("new colony", "sector 7"),
    ("mianwali colony", "sector 12"),
    ("jacobpura", "sector 12"),
    ("rajiv nagar", "sector 13"),
    ("ashok vihar", "sector 3"),
    ("dlf phase 1", "sector 26"),
    ("nirvana country", "sector 50"),
    ("palam vihar", "sector 2"),
    ("dlf phase 2", "sector 25"),
    ("sushant lok phase 1", "sector 43"),
    ("laxman vihar", "sector 4"),
    ("dlf phase 4", "sector 28"),
    ("dlf phase 3", "sector 24"),
    ("sushant lok phase 3", "sector 57"),
    ("dlf phase 5", "sector 43"),
    ("rajendra park", "sector 105"),
    ("uppals southend", "sector 49"),
    ("sohna", "sohna road"),
    ("ashok vihar phase 3 extension", "sector 5"),
    ("south city 1", "sector 41"),
    ("ashok vihar phase 2", "sector 5"),
    ("sector 95a", "sector 95"),
    ("sector 23a", "sector 23"),
    ("sector 12a", "sector 12"),
    ("sector 3a", "sector 3"),
    ("sector 110 a", "sector 110"),
    ("patel nagar", "sector 15"),
    ("a block sector 43", "sector 43"),
    ("maruti kunj", "sector 12"),
    ("b block sector 43", "sector 43"),
    ("sector-33 sohna road", "sector 33"),
    ("sector 1 manesar", "manesar"),
    ("sector 4 phase 2", "sector 4"),
    ("sector 1a manesar", "manesar"),
    ("c block sector 43", "sector 43"),
    ("sector 89 a", "sector 89"),
    ("sector 2 extension", "sector 2"),
    ("sector 36 sohna road", "sector 36"),
]

# Replacements applied after the aliases.
SECTOR_CLEANUPS = [
    ("sector 95a", "sector 95"),
    ("sector 23a", "sector 23"),
    ("new sector 2", "sector 110"),
]

# Weight of each amenity in the luxury score.
AMENITY_WEIGHTS = {
    "24/7 Power Backup": 8,
    "24/7 Water Supply": 4,
    "24x7 Security": 7,
    "ATM": 4,
    "Aerobics Centre": 6,
    "Airy Rooms": 8,
    "Amphitheatre": 7,
    "Badminton Court": 7,
    "Banquet Hall": 8,
    "Bar/Chill-Out Lounge": 9,
    "Barbecue": 7,
    "Basketball Court": 7,
    "Billiards": 7,
    "Bowling Alley": 8,
    "Business Lounge": 9,
    "CCTV Camera Security": 8,
    "Cafeteria": 6,
    "Car Parking": 6,
    "Card Room": 6,
    "Centrally Air Conditioned": 9,
    "Changing Area": 6,
    "Children's Play Area": 7,
    "Cigar Lounge": 9,
    "Clinic": 5,
    "Club House": 9,
    "Concierge Service": 9,
    "Conference room": 8,
    "Creche/Day care": 7,
    "Cricket Pitch": 7,
    "Doctor on Call": 6,
    "Earthquake Resistant": 5,
    "Entrance Lobby": 7,
    "False Ceiling Lighting": 6,
    "Feng Shui / Vaastu Compliant": 5,
    "Fire Fighting Systems": 8,
    "Fitness Centre / GYM": 8,
    "Flower Garden": 7,
    "Food Court": 6,
    "Foosball": 5,
    "Football": 7,
    "Fountain": 7,
    "Gated Community": 7,
    "Golf Course": 10,
    "Grocery Shop": 6,
    "Gymnasium": 8,
    "High Ceiling Height": 8,
    "High Speed Elevators": 8,
    "Infinity Pool": 9,
    "Intercom Facility": 7,
    "Internal Street Lights": 6,
    "Internet/wi-fi connectivity": 7,
    "Jacuzzi": 9,
    "Jogging Track": 7,
    "Landscape Garden": 8,
    "Laundry": 6,
    "Lawn Tennis Court": 8,
    "Library": 8,
    "Lounge": 8,
    "Low Density Society": 7,
    "Maintenance Staff": 6,
    "Manicured Garden": 7,
    "Medical Centre": 5,
    "Milk Booth": 4,
    "Mini Theatre": 9,
    "Multipurpose Court": 7,
    "Multipurpose Hall": 7,
    "Natural Light": 8,
    "Natural Pond": 7,
    "Park": 8,
    "Party Lawn": 8,
    "Piped Gas": 7,
    "Pool Table": 7,
    "Power Back up Lift": 8,
    "Private Garden / Terrace": 9,
    "Property Staff": 7,
    "RO System": 7,
    "Rain Water Harvesting": 7,
    "Reading Lounge": 8,
    "Restaurant": 8,
    "Salon": 8,
    "Sauna": 9,
    "Security / Fire Alarm": 9,
    "Security Personnel": 9,
    "Separate entry for servant room": 8,
    "Sewage Treatment Plant": 6,
    "Shopping Centre": 7,
    "Skating Rink": 7,
    "Solar Lighting": 6,
    "Solar Water Heating": 7,
    "Spa": 9,
    "Spacious Interiors": 9,
    "Squash Court": 8,
    "Steam Room": 9,
    "Sun Deck": 8,
    "Swimming Pool": 8,
    "Temple": 5,
    "Theatre": 9,
    "Toddler Pool": 7,
    "Valet Parking": 9,
    "Video Door Security": 9,
    "Visitor Parking": 7,
    "Water Softener Plant": 7,
    "Water Storage": 7,
    "Water purifier": 7,
    "Yoga/Meditation Area": 7,
}

# City names and the canonical name of each.
CITY_ALIASES = {
    "gurgaon": "gurgaon",
    "gurugram": "gurgaon",
    "bangalore": "bangalore",
    "bengaluru": "bangalore",
    "mumbai": "mumbai",
    "delhi": "delhi",
    "hyderabad": "hyderabad",
    "chennai": "chennai",
    "pune": "pune",
    "kolkata": "kolkata",
    "noida": "noida",
}

# Latitude and longitude of known places in Gurgaon.
GURGAON_PLACES = [
    ("sector 1", 28.4595, 77.0266),
    ("sector 2", 28.4795, 77.0426),
    ("sector 3", 28.4760, 77.0312),
    ("sector 4", 28.4691, 77.0289),
    ("sector 5", 28.4685, 77.0411),
    ("sector 6", 28.4612, 77.0400),
    ("sector 7", 28.4590, 77.0355),
    ("sector 8", 28.4536, 77.0321),
    ("sector 9", 28.4498, 77.0265),
    ("sector 10", 28.4462, 77.0227),
    ("sector 11", 28.4567, 77.0162),
    ("sector 12", 28.4631, 77.0212),
    ("sector 13", 28.4696, 77.0182),
    ("sector 14", 28.4749, 77.0317),
    ("sector 15", 28.4612, 77.0357),
    ("sector 17", 28.4655, 77.0489),
    ("sector 21", 28.4828, 77.0773),
    ("sector 22", 28.4843, 77.0825),
    ("sector 23", 28.4769, 77.0683),
    ("sector 24", 28.4723, 77.0612),
    ("sector 25", 28.4651, 77.0759),
    ("sector 26", 28.4622, 77.0863),
    ("sector 27", 28.4548, 77.0852),
    ("sector 28", 28.4708, 77.0825),
    ("sector 30", 28.4476, 77.0780),
    ("sector 31", 28.4475, 77.0660),
    ("sector 33", 28.4413, 77.0561),
    ("sector 36", 28.4385, 77.0480),
    ("sector 37", 28.4319, 77.0408),
    ("sector 37d", 28.4287, 77.0356),
    ("sector 38", 28.4247, 77.0317),
    ("sector 39", 28.4202, 77.0270),
    ("sector 40", 28.4156, 77.0223),
    ("sector 41", 28.4097, 77.0177),
    ("sector 43", 28.4378, 77.0934),
    ("sector 45", 28.4502, 77.0997),
    ("sector 46", 28.4597, 77.1077),
    ("sector 47", 28.4666, 77.1145),
    ("sector 48", 28.4239, 77.0617),
    ("sector 49", 28.4181, 77.0664),
    ("sector 50", 28.4129, 77.0712),
    ("sector 51", 28.4476, 77.0934),
    ("sector 52", 28.4413, 77.1004),
    ("sector 53", 28.4347, 77.1085),
    ("sector 54", 28.4286, 77.1166),
    ("sector 55", 28.4220, 77.1245),
    ("sector 56", 28.4170, 77.1343),
    ("sector 57", 28.4112, 77.1426),
    ("sector 58", 28.4029, 77.1505),
    ("sector 59", 28.3956, 77.1572),
    ("sector 60", 28.3886, 77.1640),
    ("sector 61", 28.3812, 77.1714),
    ("sector 62", 28.3735, 77.1786),
    ("sector 63", 28.3661, 77.1852),
    ("sector 63a", 28.3589, 77.1903),
    ("sector 65", 28.3924, 77.0654),
    ("sector 66", 28.3853, 77.0594),
    ("sector 67", 28.3784, 77.0532),
    ("sector 67a", 28.3717, 77.0479),
    ("sector 68", 28.3649, 77.0428),
    ("sector 69", 28.3570, 77.0392),
    ("sector 70", 28.3494, 77.0354),
    ("sector 70a", 28.3439, 77.0316),
    ("sector 71", 28.3380, 77.0277),
    ("sector 72", 28.3315, 77.0244),
    ("sector 73", 28.3253, 77.0210),
    ("sector 74", 28.3196, 77.0184),
    ("sector 76", 28.3866, 77.0204),
    ("sector 77", 28.3801, 77.0173),
    ("sector 78", 28.3737, 77.0142),
    ("sector 79", 28.3670, 77.0114),
    ("sector 80", 28.3603, 77.0085),
    ("sector 81", 28.3554, 77.0055),
    ("sector 82", 28.3495, 77.0026),
    ("sector 82a", 28.3447, 77.0008),
    ("sector 83", 28.3401, 76.9989),
    ("sector 84", 28.3341, 76.9962),
    ("sector 85", 28.3280, 76.9931),
    ("sector 86", 28.3221, 76.9897),
    ("sector 88", 28.3092, 76.9843),
    ("sector 88a", 28.3046, 76.9826),
    ("sector 89", 28.3008, 76.9795),
    ("sector 90", 28.2981, 76.9745),
    ("sector 91", 28.2935, 76.9719),
    ("sector 92", 28.2878, 76.9700),
    ("sector 93", 28.2832, 76.9678),
    ("sector 95", 28.2758, 76.9649),
    ("sector 99", 28.5051, 76.9683),
    ("sector 102", 28.5174, 76.9744),
    ("sector 103", 28.5232, 76.9779),
    ("sector 104", 28.5285, 76.9821),
    ("sector 105", 28.5339, 76.9870),
    ("sector 106", 28.5398, 76.9923),
    ("sector 107", 28.5460, 76.9977),
    ("sector 108", 28.5518, 77.0040),
    ("sector 109", 28.5577, 77.0098),
    ("sector 110", 28.5641, 77.0156),
    ("sector 111", 28.5702, 77.0211),
    ("sector 112", 28.5761, 77.0265),
    ("sector 113", 28.5821, 77.0323),
    ("sohna road", 28.4205, 77.0455),
    ("gwal pahari", 28.4324, 77.1473),
    ("manesar", 28.3531, 76.9425),
    ("dwarka expressway", 28.5186, 77.0188),
    ("new", 28.4595, 77.0266),
]

# Latitude and longitude of known places in Bangalore.
BANGALORE_PLACES = [
    ("whitefield", 12.9698, 77.7500),
    ("koramangala", 12.9352, 77.6245),
    ("indiranagar", 12.9719, 77.6412),
    ("hsr layout", 12.9116, 77.6411),
    ("hsr", 12.9116, 77.6411),
    ("hebbal", 13.0359, 77.5970),
    ("bannerghatta road", 12.8920, 77.5980),
    ("bannerghatta", 12.8920, 77.5980),
    ("sarjapur road", 12.8987, 77.6856),
    ("sarjapur", 12.8987, 77.6856),
    ("electronic city", 12.8456, 77.6603),
    ("electronics city", 12.8456, 77.6603),
    ("electronic city phase 1", 12.8456, 77.6603),
    ("electronics city phase 1", 12.8456, 77.6603),
    ("electronic city phase 2", 12.8410, 77.6730),
    ("electronics city phase 2", 12.8410, 77.6730),
    ("jp nagar", 12.9080, 77.5851),
    ("jayanagar", 12.9300, 77.5840),
    ("btm layout", 12.9166, 77.6101),
    ("btm", 12.9166, 77.6101),
    ("marathahalli", 12.9591, 77.6974),
    ("kr puram", 13.0067, 77.6953),
    ("k.r. puram", 13.0067, 77.6953),
    ("kr.puram", 13.0067, 77.6953),
    ("thanisandra", 13.0688, 77.6190),
    ("yelahanka", 13.1007, 77.5963),
    ("rajajinagar", 12.9912, 77.5547),
    ("banashankari", 12.9248, 77.5669),
    ("malleshwaram", 13.0036, 77.5694),
    ("malleswaram", 13.0036, 77.5694),
    ("hosur road", 12.8830, 77.6500),
    ("kanakapura road", 12.8770, 77.5448),
    ("mysore road", 12.9510, 77.5040),
    ("mysuru road", 12.9510, 77.5040),
    ("tumkur road", 13.0270, 77.5180),
    ("old madras road", 13.0150, 77.6730),
    ("old airport road", 12.9715, 77.6660),
    ("cv raman nagar", 12.9856, 77.6644),
    ("rt nagar", 13.0220, 77.5934),
    ("devanahalli", 13.2476, 77.7110),
    ("doddaballapur road", 13.1320, 77.5790),
    ("doddaballapur", 13.2941, 77.5377),
    ("kengeri", 12.9081, 77.4820),
    ("rajaji nagar", 12.9912, 77.5547),
    ("vijayanagar", 12.9719, 77.5300),
    ("basavanagudi", 12.9419, 77.5750),
    ("bsk", 12.9248, 77.5669),
    ("bommanahalli", 12.9050, 77.6210),
    ("bellandur", 12.9258, 77.6760),
    ("kasavanahalli", 12.9069, 77.7070),
    ("varthur", 12.9410, 77.7470),
    ("mahadevapura", 12.9897, 77.6957),
    ("panathur", 12.9398, 77.6988),
    ("akshaya nagar", 12.8809, 77.6378),
    ("arekere", 12.8930, 77.5900),
    ("chikkalasandra", 12.9090, 77.5447),
    ("kothanur", 13.0613, 77.6498),
    ("jakkur", 13.0791, 77.6077),
    ("kalkere", 13.0240, 77.7150),
    ("horamavu", 13.0306, 77.6634),
    ("banaswadi", 13.0152, 77.6500),
    ("kammanahalli", 13.0148, 77.6432),
    ("kalyan nagar", 13.0258, 77.6428),
    ("lingarajapuram", 13.0099, 77.6370),
    ("ramamurthy nagar", 13.0245, 77.6750),
    ("nagavara", 13.0398, 77.6228),
    ("silk board", 12.9180, 77.6228),
    ("central bangalore", 12.9716, 77.5946),
    ("north bangalore", 13.0827, 77.5870),
    ("south bangalore", 12.9134, 77.5895),
    ("east bangalore", 12.9716, 77.6940),
    ("west bangalore", 12.9716, 77.5170),
    ("bangalore north", 13.0827, 77.5870),
    ("bangalore south", 12.9134, 77.5895),
    ("bangalore east", 12.9716, 77.6940),
    ("bangalore west", 12.9716, 77.5170),
    ("bangalore", 12.9716, 77.5946),
    ("whitefield, bangalore", 12.9698, 77.7500),
    ("hennur road", 13.0420, 77.6440),
    ("hennur", 13.0420, 77.6440),
    ("soukya road", 12.9970, 77.7560),
    ("channasandra", 13.0320, 77.7370),
    ("medahalli", 13.0180, 77.7400),
    ("budigere cross", 13.0410, 77.7670),
    ("chandapura", 12.7984, 77.7042),
    ("attibele", 12.7867, 77.7710),
    ("anekal", 12.7088, 77.6960),
    ("jigani", 12.7783, 77.6385),
    ("kanakapura", 12.5470, 77.4172),
    ("rajanukunte", 13.1330, 77.5810),
    ("rajankunte", 13.1330, 77.5810),
    ("hosakerehalli", 12.9210, 77.5440),
    ("kr pura", 13.0067, 77.6953),
    ("krishnaraja puram", 13.0067, 77.6953),
    ("mahalakshmi layout", 13.0040, 77.5485),
    ("kanakapura main road", 12.8770, 77.5448),
    ("hoodi", 12.9912, 77.7180),
    ("frazer town", 12.9990, 77.6125),
    ("ulsoor", 12.9820, 77.6201),
    ("ashok nagar", 12.9716, 77.6041),
    ("shivajinagar", 12.9870, 77.6010),
    ("shivaji nagar", 12.9870, 77.6010),
    ("majestic", 12.9774, 77.5713),
    ("gandhi nagar", 12.9783, 77.5712),
    ("wilson garden", 12.9530, 77.5996),
    ("lavelle road", 12.9719, 77.5970),
    ("mg road", 12.9756, 77.6090),
    ("brigade road", 12.9716, 77.6090),
    ("commercial street", 12.9837, 77.6094),
    ("cunningham road", 12.9888, 77.5970),
    ("richmond road", 12.9670, 77.6010),
    ("uttarahalli", 12.9050, 77.5460),
    ("yelahanka new town", 13.1007, 77.5963),
    ("kogilu", 13.1100, 77.6240),
    ("bommasandra", 12.8060, 77.7000),
    ("singasandra", 12.8810, 77.6420),
    ("begur", 12.8688, 77.6240),
    ("hulimavu", 12.8810, 77.6020),
    ("gottigere", 12.8740, 77.5920),
    ("kaggalipura", 12.7967, 77.5610),
    ("kaggadasapura", 12.9760, 77.6790),
    ("mahadevpura", 12.9897, 77.6957),
    ("whitefield road", 12.9698, 77.7500),
    ("kadugodi", 13.0026, 77.7530),
    ("avalahalli", 13.0290, 77.7550),
    ("kodathi", 12.9080, 77.7180),
    ("green glen layout", 12.9290, 77.6770),
    ("haralur", 12.9090, 77.6740),
    ("haralur road", 12.9090, 77.6740),
    ("iblur", 12.9230, 77.6700),
    ("doddanekundi", 12.9760, 77.7000),
    ("aecs layout", 12.9760, 77.7180),
    ("munnekollal", 12.9540, 77.7090),
    ("thubarahalli", 12.9540, 77.7250),
    ("brookefield", 12.9670, 77.7180),
    ("kundalahalli", 12.9760, 77.7080),
    ("sadaramangala", 12.9890, 77.7110),
    ("hoodi circle", 12.9912, 77.7180),
]

# Names that stand for a whole city, not a place in it.
GENERIC_PLACES = [
    "bangalore",
    "gurgaon",
    "new",
    "central bangalore",
    "north bangalore",
    "south bangalore",
    "east bangalore",
    "west bangalore",
    "bangalore north",
    "bangalore south",
    "bangalore east",
    "bangalore west",
]

# The generic name whose coordinates stand for each city.
CITY_CENTRES = {"gurgaon": "new", "bangalore": "bangalore"}


def gazetteer(spark: SparkSession) -> DataFrame:
    """Known places as a table (city, ord, key, lat, lon, is_generic, is_centre)."""
    rows = [
        (city, ord_, key, lat, lon, key in GENERIC_PLACES, CITY_CENTRES[city] == key)
        for city, places in (("gurgaon", GURGAON_PLACES), ("bangalore", BANGALORE_PLACES))
        for ord_, (key, lat, lon) in enumerate(places)
    ]
    return spark.createDataFrame(
        rows,
        "city string, ord int, key string, lat double, lon double, is_generic boolean, is_centre boolean",
    )
