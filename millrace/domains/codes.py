"""Public code sets the rule packs refer to. Country codes come from the JVM's own ISO 3166 tables."""

from __future__ import annotations

from functools import lru_cache

# Codes of public standards (ISO 4217, ISO 639-1, UN/CEFACT Rec. 20, HL7 FHIR, LOINC, FAO, USDA, ADAPT, Ed-Fi, EIDR, DDEX).
ISO4217 = (
    'AED', 'AFN', 'ALL', 'AMD', 'ANG', 'AOA', 'ARS', 'AUD', 'AWG', 'AZN', 'BAM', 'BBD', 'BDT', 'BGN', 'BHD', 'BIF',
    'BMD', 'BND', 'BOB', 'BOV', 'BRL', 'BSD', 'BTN', 'BWP', 'BYN', 'BZD', 'CAD', 'CDF', 'CHE', 'CHF', 'CHW', 'CLF',
    'CLP', 'CNY', 'COP', 'COU', 'CRC', 'CUP', 'CVE', 'CZK', 'DJF', 'DKK', 'DOP', 'DZD', 'EGP', 'ERN', 'ETB', 'EUR',
    'FJD', 'FKP', 'GBP', 'GEL', 'GHS', 'GIP', 'GMD', 'GNF', 'GTQ', 'GYD', 'HKD', 'HNL', 'HTG', 'HUF', 'IDR', 'ILS',
    'INR', 'IQD', 'IRR', 'ISK', 'JMD', 'JOD', 'JPY', 'KES', 'KGS', 'KHR', 'KMF', 'KPW', 'KRW', 'KWD', 'KYD', 'KZT',
    'LAK', 'LBP', 'LKR', 'LRD', 'LSL', 'LYD', 'MAD', 'MDL', 'MGA', 'MKD', 'MMK', 'MNT', 'MOP', 'MRU', 'MUR', 'MVR',
    'MWK', 'MXN', 'MXV', 'MYR', 'MZN', 'NAD', 'NGN', 'NIO', 'NOK', 'NPR', 'NZD', 'OMR', 'PAB', 'PEN', 'PGK', 'PHP',
    'PKR', 'PLN', 'PYG', 'QAR', 'RON', 'RSD', 'RUB', 'RWF', 'SAR', 'SBD', 'SCR', 'SDG', 'SEK', 'SGD', 'SHP', 'SLE',
    'SOS', 'SRD', 'SSP', 'STN', 'SVC', 'SYP', 'SZL', 'THB', 'TJS', 'TMT', 'TND', 'TOP', 'TRY', 'TTD', 'TWD', 'TZS',
    'UAH', 'UGX', 'USD', 'USN', 'UYI', 'UYU', 'UYW', 'UZS', 'VED', 'VES', 'VND', 'VUV', 'WST', 'XAF', 'XAG', 'XAU',
    'XCD', 'XDR', 'XOF', 'XPD', 'XPF', 'XPT', 'XSU', 'XTS', 'XUA', 'XXX', 'YER', 'ZAR', 'ZMW', 'ZWL',
)
ISO639 = (
    'aa', 'ab', 'ae', 'af', 'ak', 'am', 'an', 'ar', 'as', 'av', 'ay', 'az', 'ba', 'be', 'bg', 'bh', 'bi', 'bm', 'bn',
    'bo', 'br', 'bs', 'ca', 'ce', 'ch', 'co', 'cr', 'cs', 'cu', 'cv', 'cy', 'da', 'de', 'dv', 'dz', 'ee', 'el', 'en',
    'eo', 'es', 'et', 'eu', 'fa', 'ff', 'fi', 'fj', 'fo', 'fr', 'fy', 'ga', 'gd', 'gl', 'gn', 'gu', 'gv', 'ha', 'he',
    'hi', 'ho', 'hr', 'ht', 'hu', 'hy', 'hz', 'ia', 'id', 'ie', 'ig', 'ii', 'ik', 'io', 'is', 'it', 'iu', 'ja', 'jv',
    'ka', 'kg', 'ki', 'kj', 'kk', 'kl', 'km', 'kn', 'ko', 'kr', 'ks', 'ku', 'kv', 'kw', 'ky', 'la', 'lb', 'lg', 'li',
    'ln', 'lo', 'lt', 'lu', 'lv', 'mg', 'mh', 'mi', 'mk', 'ml', 'mn', 'mr', 'ms', 'mt', 'my', 'na', 'nb', 'nd', 'ne',
    'ng', 'nl', 'nn', 'no', 'nr', 'nv', 'ny', 'oc', 'oj', 'om', 'or', 'os', 'pa', 'pi', 'pl', 'ps', 'pt', 'qu', 'rm',
    'rn', 'ro', 'ru', 'rw', 'sa', 'sc', 'sd', 'se', 'sg', 'si', 'sk', 'sl', 'sm', 'sn', 'so', 'sq', 'sr', 'ss', 'st',
    'su', 'sv', 'sw', 'ta', 'te', 'tg', 'th', 'ti', 'tk', 'tl', 'tn', 'to', 'tr', 'ts', 'tt', 'tw', 'ty', 'ug', 'uk',
    'ur', 'uz', 've', 'vi', 'vo', 'wa', 'wo', 'xh', 'yi', 'yo', 'za', 'zh', 'zu',
)
UOM = (
    'KGM', 'GRM', 'MGM', 'TNE', 'DTN', 'LBR', 'ONZ', 'CGM', 'HGM', 'LTR', 'MLT', 'CLT', 'DLT', 'HLT', 'CMQ', 'DMQ',
    'MTQ', 'MMQ', 'GLL', 'GLI', 'PT', 'QT', 'FOZ', 'OZA', 'MTR', 'CMT', 'MMT', 'DMT', 'KMT', 'MTK', 'CMK', 'MMK', 'KMK',
    'INH', 'FOT', 'YRD', 'MIK', 'EA', 'H87', 'C62', 'NMP', 'SET', 'PR', 'DZN', 'PK', 'BX', 'CT', 'PCE', 'NIU', 'XPP',
)
GENDER = (
    'male', 'female', 'other', 'unknown',
)
OBSERVATION_STATUS = (
    'registered', 'preliminary', 'final', 'amended', 'corrected', 'cancelled', 'entered-in-error', 'unknown',
)
ENCOUNTER_STATUS = (
    'planned', 'arrived', 'triaged', 'in-progress', 'onleave', 'finished', 'cancelled', 'entered-in-error', 'unknown',
)
LOINC = (
    '10839-9', '11580-8', '13457-7', '14647-2', '14682-9', '14920-3', '14959-1', '1742-6', '1751-7', '1759-0',
    '17856-6', '17861-6', '18262-6', '1920-8', '1968-7', '1975-2', '1986-9', '1988-5', '1989-3', '2027-1', '2028-9',
    '20454-5', '2075-0', '2085-9', '2089-1', '2093-3', '2132-9', '2157-6', '2160-0', '2276-4', '2284-8', '2339-0',
    '2345-7', '2502-3', '2532-0', '2571-8', '2708-6', '2823-3', '2885-2', '2888-6', '29463-7', '2951-2', '3016-3',
    '3024-7', '3026-2', '30522-7', '3094-0', '3141-9', '3173-2', '33762-6', '33914-3', '39156-5', '4544-3', '4548-4',
    '48642-3', '48643-1', '55284-4', '56799-0', '5792-7', '5803-2', '5811-5', '5902-2', '5905-5', '59408-5', '5964-2',
    '6301-6', '6690-2', '6768-6', '711-2', '713-8', '718-7', '72166-2', '736-9', '742-7', '76690-7', '770-8', '777-3',
    '785-6', '786-4', '787-2', '788-0', '789-8', '8287-5', '8302-2', '8310-5', '8462-4', '8478-0', '8480-6', '85354-9',
    '8716-3', '8867-4', '9279-1', '9843-4',
)
GRADE_LEVELS = (
    'Infant/toddler', 'Preschool/Prekindergarten', 'Transitional Kindergarten', 'Kindergarten', 'First grade',
    'Second grade', 'Third grade', 'Fourth grade', 'Fifth grade', 'Sixth grade', 'Seventh grade', 'Eighth grade',
    'Ninth grade', 'Tenth grade', 'Eleventh grade', 'Twelfth grade', 'Postsecondary', 'Adult Education', 'Other',
    'Ungraded',
)
EXIT_TYPES = (
    'Transferred', 'Graduated', 'Dropped out', 'Completed', 'Other', 'Unknown',
)
SCORE_TYPES = (
    'Raw score', 'Scale score', 'Percentile', 'Percentile rank', 'Proficiency level', 'Growth percentile',
)
OPERATIONS = (
    'Planting', 'Harvesting', 'Tillage', 'Application', 'Irrigation', 'Scouting', 'Sampling', 'Other',
)
CROPS = (
    '15', '27', '44', '56', '71', '75', '79', '83', '89', '92', '94', '97', '103', '116', '122', '125', '136', '137',
    '149', '156', '157', '176', '181', '187', '191', '195', '197', '201', '203', '210', '211', '236', '242', '249',
    '254', '256', '260', '263', '265', '267', '270', '275', '280', '289', '292', '296', '299', '328', '333', '336',
    '358', '366', '367', '372', '373', '388', '393', '394', '397', '399', '401', '403', '406', '407', '414', '417',
    '423', '426', '430', '446', '449', '463', '486', '489', '490', '495', '497', '507', '515', '521', '523', '526',
    '530', '531', '534', '536', '544', '547', '549', '550', '552', '554', '560', '567', '568', '569', '571', '572',
    '574', '577', '587', '591', '600', '603', '656', '661', '667', '671', '674', '689', '692', '693', '698', '702',
    '711', '720', '723', '748', '754', '773', '777', '780', '789', '800', '821', '826', '836',
)
AREA_UNITS = (
    'ACR', 'HAR', 'MTK', 'KMK', 'CMK', 'MMK', 'FTK', 'YDK', 'INK', 'MIK', 'DAA', 'ARE',
)
YIELD_UNITS = (
    'KGM', 'GRM', 'TNE', 'DTN', 'LBR', 'ONZ', 'CWA', 'CWI', 'BU', 'STI', 'LTN', 'BG',
)
SOIL_TEXTURES = (
    'Sand', 'Loamy sand', 'Sandy loam', 'Loam', 'Silt loam', 'Silt', 'Sandy clay loam', 'Clay loam', 'Silty clay loam',
    'Sandy clay', 'Silty clay', 'Clay',
)
EIDR_TYPES = (
    'Movie', 'Short', 'Web', 'TV', 'Season', 'Episode', 'Clip', 'Manifestation', 'Supplemental', 'Collection',
)
DDEX_RELEASES = (
    'Album', 'Single', 'EP', 'Ringtone', 'RingbackTone', 'BackCoverImage', 'BookletBackImage', 'BookletFrontImage',
    'StickerImage', 'VideoChapter', 'TrackRelease', 'ClassicalAlbum', 'ConcertVideo', 'DocuVideo', 'Episode',
    'LiveEventVideo', 'LyricVideo', 'MusicVideo', 'StudioVideo', 'AudioBookRelease', 'AudioDramaRelease', 'DjMix',
    'MultimediaRelease', 'PlayList', 'LongFormMusicalWorkVideoRelease',
)
DDEX_ROLES = (
    'MainArtist', 'FeaturedArtist', 'Composer', 'Lyricist', 'MusicPublisher', 'RecordCompany', 'Distributor',
    'SubDistributor', 'OriginalPublisher', 'SubPublisher', 'Arranger', 'Producer', 'AssociatedPerformer', 'Conductor',
    'Orchestra', 'Ensemble', 'Engineer', 'Mixer', 'Remixer', 'Performer',
)
AREA_SPELLINGS = {
    'acres': 'ACR', 'acre': 'ACR', 'ac': 'ACR', 'hectares': 'HAR', 'hectare': 'HAR', 'ha': 'HAR', 'sqft': 'FTK',
    'sq_ft': 'FTK', 'square_feet': 'FTK', 'ft2': 'FTK', 'sqm': 'MTK', 'square_meters': 'MTK', 'square_metres': 'MTK',
    'm2': 'MTK', 'sqkm': 'KMK', 'square_kilometers': 'KMK', 'km2': 'KMK', 'sqyd': 'YDK', 'square_yards': 'YDK',
    'yd2': 'YDK',
}
YIELD_SPELLINGS = {
    'bushels': 'BU', 'bushel': 'BU', 'bu': 'BU', 'kg': 'KGM', 'kilograms': 'KGM', 'kilogram': 'KGM', 'kgs': 'KGM',
    'tons': 'TNE', 'tonnes': 'TNE', 'tonne': 'TNE', 't': 'TNE', 'metric_tons': 'TNE', 'metric_ton': 'TNE', 'mt': 'TNE',
    'lbs': 'LBR', 'pounds': 'LBR', 'pound': 'LBR', 'lb': 'LBR', 'g': 'GRM', 'grams': 'GRM', 'gram': 'GRM',
    'quintals': 'DTN', 'quintal': 'DTN',
}
ROUTE_TYPES = (0, 1, 2, 3, 4, 5, 6, 7, 11, 12)


@lru_cache
def countries(three: bool = True) -> tuple[str, ...]:
    """ISO 3166 alpha-2 codes, with ``three`` the alpha-3 codes too."""
    from pyspark import SparkContext

    jvm = SparkContext._active_spark_context._jvm
    two = list(jvm.java.util.Locale.getISOCountries())
    return tuple(two + ([jvm.java.util.Locale("", x).getISO3Country() for x in two] if three else []))
