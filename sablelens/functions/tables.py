"""Dimension tables of tags and elements. All are fixed values."""

from __future__ import annotations

# TIFF: names of tags by number.
TAG_NAMES = {
    254: "NewSubfileType",
    256: "ImageWidth",
    257: "ImageLength",
    258: "BitsPerSample",
    259: "Compression",
    262: "PhotometricInterpretation",
    270: "ImageDescription",
    271: "Make",
    272: "Model",
    273: "StripOffsets",
    278: "RowsPerStrip",
    279: "StripByteCounts",
    282: "XResolution",
    283: "YResolution",
    296: "ResolutionUnit",
    305: "Software",
    306: "DateTime",
    315: "Artist",
    316: "HostComputer",
    324: "TileOffsets",
    325: "TileByteCounts",
    330: "SubIFDs",
    36867: "DateTimeOriginal",
    36868: "DateTimeDigitized",
    65420: "NDPI_FORMAT_FLAG",
    65421: "NDPI_SOURCELENS",
    65422: "NDPI_XOFFSET",
    65423: "NDPI_YOFFSET",
    65424: "NDPI_ZOFFSET",
    65425: "NDPI_UNKNOWN_65425",
    65426: "NDPI_JPEGQUALITY",
    65427: "NDPI_REFERENCE",
    65428: "NDPI_IMGSIZE",
    65429: "NDPI_UNKNOWN_65429",
    65432: "NDPI_UNKNOWN_65432",
    65433: "NDPI_UNKNOWN_65433",
    65439: "NDPI_FOCUSPOINTS",
    65440: "NDPI_UNKNOWN_65440",
    65441: "NDPI_CAPTUREMODE",
    65442: "NDPI_SERIAL_NUMBER",
    65449: "NDPI_SCANNER_PROPS",
    65457: "NDPI_UNKNOWN_65457",
    65458: "NDPI_UNKNOWN_65458",
    65459: "NDPI_UNKNOWN_65459",
    65468: "NDPI_BARCODE",
    65469: "NDPI_UNKNOWN_65469",
    65476: "NDPI_UNKNOWN_65476",
    65477: "NDPI_SCANPROFILE",
    65478: "NDPI_UNKNOWN_65478",
    65480: "NDPI_BARCODE_TYPE",
}
# TIFF: bytes of one value by type number.
TYPE_BYTES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 16: 8, 17: 8}
DATE_TAGS = {306: "DateTime", 36867: "DateTimeOriginal", 36868: "DateTimeDigitized"}
EXTRA_TAGS = {270: "ImageDescription", 305: "Software", 315: "Artist", 316: "HostComputer", 700: "XMP", 33432: "Copyright", 33723: "IPTC", 34675: "ICCProfile", 37510: "UserComment", 42016: "ImageUniqueID"}
EXIF_TAGS = {36867: "DateTimeOriginal", 36868: "DateTimeDigitized", 37510: "UserComment", 37520: "SubSecTime", 37521: "SubSecTimeOriginal", 37522: "SubSecTimeDigitized", 42016: "ImageUniqueID"}
GPS_NAMES = (
    "GPSVersionID GPSLatitudeRef GPSLatitude GPSLongitudeRef GPSLongitude GPSAltitudeRef GPSAltitude GPSTimeStamp GPSSatellites GPSStatus GPSMeasureMode GPSDOP GPSSpeedRef GPSSpeed GPSTrackRef GPSTrack "
    "GPSImgDirectionRef GPSImgDirection GPSMapDatum GPSDestLatitudeRef GPSDestLatitude GPSDestLongitudeRef GPSDestLongitude GPSDestBearingRef GPSDestBearing GPSDestDistanceRef GPSDestDistance "
    "GPSProcessingMethod GPSAreaInformation GPSDateStamp GPSDifferential GPSHPositioningError"
).split()
EXIF_POINTER, GPS_POINTER = 34665, 34853
# NDPI.
NDPI_TAGS = {65468: "NDPI_BARCODE", 65427: "NDPI_REFERENCE", 65442: "NDPI_SERIAL_NUMBER"}
NDPI_PROPS, NDPI_LENS, NDPI_PRIVATE = 65449, 65421, (65420, 65480)
NDPI_LENSES = {-1.0: "MacroImage", -2.0: "LabelImage"}
NDPI_HANDLED = (65421, 65427, 65442, 65449, 65468, 65420, 65422, 65423, 65424, 65425, 65426, 65428, 65429, 65432, 65433, 65439, 65440, 65441, 65457, 65458, 65459, 65464, 65465, 65469, 65476, 65478)
# MRXS: fields of the section GENERAL, of all others, and layers of associated images.
MRXS_GENERAL = ("SLIDE_ID", "SLIDE_NAME", "SLIDE_BARCODE", "SLIDE_CREATIONDATETIME", "SLIDE_QUALITY", "PROJECT_NAME", "SLIDE_LABEL")
MRXS_OTHER = ("SLIDE_DESCRIPTION", "SLIDE_CREATOR", "SLIDE_COMMENT", "PATIENT_ID", "PATIENT_NAME", "CASE_ID", "CASE_NUMBER", "ACCESSION_NUMBER", "PHYSICIAN_NAME", "OPERATOR")
MRXS_LAYERS = {
    "ScanDataLayer_SlideBarcode": "LabelImage",
    "ScanDataLayer_SlideLabel": "LabelImage",
    "ScanDataLayer_SlideBarcodeImage": "LabelImage",
    "ScanDataLayer_SlidePreview": "MacroImage",
    "ScanDataLayer_SlideMacro": "MacroImage",
    "ScanDataLayer_SlideOverview": "MacroImage",
    "ScanDataLayer_SlideThumbnail": "ThumbnailImage",
}
MRXS_OFFSET_KEYS, MRXS_SIZE_KEYS = ("FILE_OFFSET", "FILEOFFSET", "OFFSET"), ("FILE_SIZE", "FILESIZE", "SIZE", "BYTECOUNT")
# DICOM: elements blanked, `group,element name VR` each.
DICOM_BLANK = """
0010,0010 PatientName PN
0010,0020 PatientID LO
0010,0030 PatientBirthDate DA
0010,0040 PatientSex CS
0010,1010 PatientAge AS
0010,1020 PatientSize DS
0010,1030 PatientWeight DS
0008,0050 AccessionNumber SH
0020,0010 StudyID SH
0008,0020 StudyDate DA
0008,0030 StudyTime TM
0008,1030 StudyDescription LO
0008,0080 InstitutionName LO
0008,0090 ReferringPhysicianName PN
0008,0021 SeriesDate DA
0008,0031 SeriesTime TM
0008,103E SeriesDescription LO
0008,1070 OperatorsName PN
0020,0011 SeriesNumber IS
0008,0023 ContentDate DA
0008,0033 ContentTime TM
0008,0022 AcquisitionDate DA
0008,0032 AcquisitionTime TM
0008,002A AcquisitionDateTime DT
0040,0512 ContainerIdentifier LO
0040,0551 SpecimenIdentifier LO
0018,1000 DeviceSerialNumber LO
0018,1020 SoftwareVersions LO
0008,0012 InstanceCreationDate DA
0008,0013 InstanceCreationTime TM
0010,2180 Occupation SH
0010,0021 IssuerOfPatientID LO
0010,0022 TypeOfPatientID CS
0040,0241 PerformedStationAETitle AE
0040,0242 PerformedStationName SH
0040,0243 PerformedLocation SH
0040,0253 PerformedProcedureStepID SH
0040,0244 PerformedProcedureStepStartDate DA
0040,0245 PerformedProcedureStepStartTime TM
0040,0250 PerformedProcedureStepEndDate DA
0040,0251 PerformedProcedureStepEndTime TM
"""
# DICOM: elements deleted, `group,element name` each.
DICOM_DELETE = """
0010,1000 OtherPatientIDs
0010,1001 OtherPatientNames
0010,1002 OtherPatientIDsSequence
0010,1040 PatientAddress
0010,2154 PatientTelephoneNumbers
0010,1060 PatientMotherBirthName
0010,2110 Allergies
0010,21B0 AdditionalPatientHistory
0010,4000 PatientComments
0010,2160 EthnicGroup
0010,0050 PatientInsurancePlanCodeSequence
0010,21F0 PatientReligiousPreference
0008,0081 InstitutionAddress
0008,0082 InstitutionCodeSequence
0008,1040 InstitutionalDepartmentName
0008,1010 StationName
0008,1048 PhysiciansOfRecord
0008,1049 PhysiciansOfRecordIdentificationSequence
0008,1050 PerformingPhysicianName
0008,1052 PerformingPhysicianIdentificationSequence
0008,1060 NameOfPhysiciansReadingStudy
0008,1062 PhysiciansReadingStudyIdentificationSequence
0032,1032 RequestingPhysician
0032,1033 RequestingService
0008,0092 ReferringPhysicianAddress
0008,0094 ReferringPhysicianTelephoneNumbers
0008,0096 ReferringPhysicianIdentificationSequence
0008,1032 ProcedureCodeSequence
0032,1060 RequestedProcedureDescription
0040,0275 RequestAttributesSequence
0040,1001 RequestedProcedureID
0040,A730 ContentSequence
0020,4000 ImageComments
0008,4000 IdentifyingComments
0038,0010 AdmissionID
0038,0500 PatientState
0040,2016 PlacerOrderNumberImagingServiceRequest
0040,2017 FillerOrderNumberImagingServiceRequest
0040,0610 SpecimenPreparationSequence
0040,0513 IssuerOfTheContainerIdentifierSequence
0040,0515 AlternateContainerIdentifierSequence
0040,0518 ContainerTypeCodeSequence
0040,0520 ContainerComponentSequence
0040,0554 SpecimenUID
0040,0555 AcquisitionContextSequence
0040,0556 AcquisitionContextDescription
0040,0560 SpecimenDescriptionSequence
0040,0562 IssuerOfTheSpecimenIdentifierSequence
0040,059A SpecimenTypeCodeSequence
0040,0600 SpecimenShortDescription
0040,0602 SpecimenDetailedDescription
0010,21D0 LastMenstrualDate
0010,0032 PatientBirthTime
0010,1005 PatientBirthName
0010,1090 MedicalRecordLocator
4008,0114 PhysicianApprovingInterpretation
0008,0014 InstanceCreatorUID
0008,1115 ReferencedSeriesSequence
0088,0140 StorageMediaFileSetUID
3006,0024 ReferencedFrameOfReferenceUID
0040,A073 VerifyingObserverSequence
0040,A075 VerifyingObserverName
0040,A088 VerifyingObserverIdentificationCodeSequence
0012,0020 ClinicalTrialProtocolID
0012,0021 ClinicalTrialProtocolName
0012,0030 ClinicalTrialSiteID
0012,0031 ClinicalTrialSiteName
0012,0040 ClinicalTrialSubjectID
0012,0042 ClinicalTrialSubjectReadingID
0012,0050 ClinicalTrialTimePointID
0012,0051 ClinicalTrialTimePointDescription
0008,1120 ReferencedPatientSequence
0008,1110 ReferencedStudySequence
0008,0058 FailedSOPInstanceUIDList
"""
# DICOM: elements of nested datasets that identify, and identifiers that are replaced by others.
DICOM_NESTED = "0010,0010 0010,0020 0010,0021 0008,0050 0008,0080 0008,0081 0008,0090 0008,1050 0008,1070 0040,A123 0040,A075 0040,0512 0040,0551 0040,0554 0040,0009 0040,1001 0040,0253".split()
DICOM_UIDS = {"0008,0018": "SOPInstanceUID", "0020,000D": "StudyInstanceUID", "0020,000E": "SeriesInstanceUID", "0020,0052": "FrameOfReferenceUID"}


def dicom_blank() -> list[tuple[str, str, str]]:
    return [tuple(line.split()) for line in DICOM_BLANK.strip().splitlines()]


def dicom_delete() -> list[tuple[str, str]]:
    return [tuple(line.split()) for line in DICOM_DELETE.strip().splitlines()]
