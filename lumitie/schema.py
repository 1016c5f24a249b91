"""Declared schemas of the stored relations; nothing is inferred on read."""

from pyspark.sql.types import (ArrayType, DoubleType, FloatType, IntegerType, LongType,
                               StringType, StructField, StructType)


def _struct(spec):
    kinds = {"d": DoubleType(), "f": FloatType(), "i": IntegerType(), "l": LongType(),
             "s": StringType(), "ad": ArrayType(DoubleType())}
    pairs = [p.split(":") for p in spec.split()]
    return StructType([StructField(n, kinds[k], True) for n, k in pairs])


MEAS = _struct(
    "objectid:s exposure:s ccdnum:i filter:s mag_auto:d magerr_auto:d mag_aper1:d magerr_aper1:d "
    "mag_aper2:d magerr_aper2:d mag_aper4:d magerr_aper4:d mag_aper8:d magerr_aper8:d "
    "kron_radius:d fwhm:d class_star:d flags:i asemi:d bsemi:d theta:d mjd:d ra:d dec:d "
    "raerr:d decerr:d x:d y:d")
CHIP = _struct("exposure:s ccdnum:i filter:s zpterm:d")
EXPOSURE = _struct("exposure:s expnum:l filter:s instrument:s mjd:d")
ANCHOR = _struct("expnum:l ccdnum:i band:s mag_zero:d sigma_mag_zero:d source:s flag:i")
EXPTIME = _struct("expnum:l exptime:d")
DETECTIONS = _struct(
    "objectid:s expnum:l ccdnum:i band:s m_inst:d m_err:d mjd:d ra:d dec:d x:f y:f fwhm:d healpix_pixel:l")
STAR_LISTS = _struct("objectid:s expnum:l ccdnum:i m_inst:d m_err:d healpix_pixel:l")
NODES = _struct("expnum:l ccdnum:i")
STAR_FLAGS = _struct("objectid:s")
EXPOSURE_FLAGS = _struct("expnum:l")
ZEROPOINTS = _struct("expnum:l ccdnum:i band:s zp_solved:d zp_fgcm:d delta_zp:d")
STAR_FLAT = _struct("ccdnum:i epoch_idx:i flat_correction:d")
POSITIONS = _struct("expnum:l ccdnum:i ra_mean:d dec_mean:d")
STARFLAT_COEFFS = _struct("ccdnum:i epoch:i n_stars:l coeffs:ad")
GAIA = _struct(
    "source_id:l ra:d dec:d phot_g_mean_mag:d phot_bp_mean_mag:d phot_rp_mean_mag:d bp_rp:d "
    "phot_g_mean_flux_over_error:d phot_bp_mean_flux_over_error:d phot_rp_mean_flux_over_error:d "
    "ag_gspphot:d ebpminrp_gspphot:d")
LEGACY = _struct(
    "ls_id:l ra:d dec:d type:s mag_g:d mag_r:d mag_i:d mag_z:d flux_ivar_g:d flux_ivar_r:d "
    "flux_ivar_i:d flux_ivar_z:d")
PS1 = _struct(
    "objID:l raMean:d decMean:d nDetections:i gMeanPSFMag:d rMeanPSFMag:d iMeanPSFMag:d zMeanPSFMag:d "
    "gMeanApMag:d rMeanApMag:d iMeanApMag:d zMeanApMag:d gQfPerfect:d rQfPerfect:d iQfPerfect:d "
    "zQfPerfect:d")
XMATCH = _struct("id1:l id2:s distance:d")
EBV = _struct("healpix_pixel:l ebv:d")
EBV_LEVELS = _struct("nside:i healpix_pixel:l ebv:d")


def catalog(band: str) -> StructType:
    """Star catalog of one band."""
    b = band
    return _struct(f"objectid:s ra:d dec:d mag_cal_{b}:d mag_starflat_{b}:d mag_before_{b}:d magerr_cal_{b}:d "
                   f"nobs_{b}:l chi2_{b}:d ebv_sfd:d mag_dered_{b}:d")
